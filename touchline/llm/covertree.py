"""Exact top-k by inner product: dual search of cover trees over queries and data.

One cover tree is grown over a bounded sample of the vectors; its upper levels, at most ``MAX_CELLS`` nodes, go to every task, and each row, query or
not, is dealt to the nearest of their centres. A cell's radius and largest norm are then taken over all its rows, so bounds by them hold whatever the sample
was. Each query first searches the ``PROBES`` cells whose centres score best. Its k-th score there rules out every cell whose rows
cannot reach it, and the query is sent to the other cells only. Rows of a cell no query reaches are not sent.

A cell's rows are split into blocks of bounded size, the queries sent to it too. In a group of two blocks both
sides are indexed by a cover tree: a node covers its points within a radius around one of them, and its children do so with a
radius smaller by ``BASE``, each child's centre outside the others' radius; the smallest nodes are left to the node above. For a query node with centre a, radius r and a data node with centre b, radius s no
pair of points scores above ``a.b + |a| s + |b| r + r s``; a pair of nodes below the worst k-th score of the query node's members is left out.
Below the smallest query nodes each query is held against the data nodes by itself. The k best of each block are then ranked together by query.

On vectors without clusters few cells are ruled out, and the work grows with queries times data.

Scores are exact: components are integers, and sums stay below 2**53 or are made with unbounded integers.

Defined cases: vectors that are null, or hold null or a component that is not finite, take no part; neither do rows whose id is null. Vectors meet those of their own
length only; vectors without components score 0. Repeated rows are rows of their own: each one of a query id is
a query, and a row's own is left out, not its equals. A query with fewer candidates than k gets all. Scores outside 64 bits are cut to their range. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, stored

K = 10
SCALE = 1024
QUERY_STEP = 100
LOWEST = -(1 << 63)

BLOCK = 2048
QUERY_BLOCK = 1024
BASE = 1.4
LEAF = 128
#: A node of fewer points is not made; they stay loose in the node above, which scores them in one product.
LEAST_NODE = 32

#: Bounds of the upper tree: rows and components of the sample it is grown over, and its cells for each length of vectors.
SAMPLE = 4096
SAMPLE_VALUES = 2_000_000
MAX_CELLS = 1024
#: A cell is made for so many rows and for so many of the sample.
CELL_ROWS = 512
CELL_SAMPLE = 4
PROBES = 2


def vectors(embeddings: DataFrame) -> DataFrame:
    """uid, id, dim and the integer components of the rows that take part."""
    parts = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("id"),
        F.size("embedding").alias("dim"),
        parts.alias("v"),
    )


class Node:
    """A centre, the radius around it, child nodes, and the places of points that are in no child."""

    __slots__ = ("centre", "centres", "children", "loose", "norm", "points", "radii", "radius")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray) -> None:
        self.centre, self.radius, self.points = centre, radius, points
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []
        self.loose = points

    def close(self, loose: list[int]) -> None:
        self.loose = np.array(loose, np.int64)
        if self.children:
            self.centres = np.stack([c.centre for c in self.children])
            self.radii = np.array([c.radius for c in self.children])


def most_possible(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no point within ``radii`` of ``centres`` scores above, for each query and centre, with room for rounding."""
    norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
    reach = np.sqrt(np.einsum("ij,ij->i", centres, centres)) + radii
    return queries @ centres.T + norms * radii + 1e-9 * norms * reach + 1e-6


def not_above(score: int) -> float:
    """The score as a double, or the next lower one."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def cover_tree(x: np.ndarray) -> Node:
    """The cover tree of the rows of ``x``; at least one row."""

    def grow(centre: int, points: np.ndarray, far: np.ndarray) -> Node:
        # The ball that bounds scores has its centre in the middle of the points where that makes it smaller.
        cover = float(far.max())
        middle = x[points].mean(axis=0)
        off = x[points] - middle
        around = float(np.sqrt(np.einsum("ij,ij->i", off, off).max()))
        node = Node(middle, around, points) if around < cover else Node(x[centre], cover, points)
        if len(points) <= LEAF or cover == 0:
            return node
        reach = cover / BASE
        loose, rest, at, far_rest = [], points, centre, far
        while len(rest):
            near = far_rest <= reach
            inside = rest[near]
            if len(inside) >= LEAST_NODE:
                node.children.append(grow(at, inside, far_rest[near]))
            else:
                loose.extend(inside)
            rest = rest[~near]
            if len(rest):
                at = rest[0]
                gap = x[rest] - x[at]
                far_rest = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        node.close(loose)
        return node

    every = np.arange(len(x))
    gap = x - x[0]
    return grow(0, every, np.sqrt(np.einsum("ij,ij->i", gap, gap)))


class Search:
    """Best candidates of a group's queries. ``worst`` is each query's k-th score so far, ``scored`` the pairs of points compared."""

    def __init__(
        self, queries: np.ndarray, uids: np.ndarray, data: np.ndarray, members: list[list[tuple[int, int]]], k: int, worst: np.ndarray | None = None
    ) -> None:
        # members: (id, uid) of the rows that have a data point's vector, the k + 1 first by id.
        self.k, self.members, self.uids = k, members, uids
        largest = max(float(np.abs(queries).max(initial=0)), float(np.abs(data).max(initial=0)))
        self.exact = largest * largest * max(queries.shape[1], 1) < 2.0**52
        kind = np.float64 if self.exact else object
        self.q, self.x = queries.astype(kind), data.astype(kind)
        self.fq, self.fx = queries.astype(np.float64), data.astype(np.float64)
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.astype(np.float64)
        self.best: list[list[tuple]] = [[] for _ in range(len(queries))]
        self.scored = 0

    def run(self) -> list[list[tuple]]:
        if len(self.fq) and len(self.fx):
            self.visit(cover_tree(self.fq), cover_tree(self.fx))
        return self.best

    @staticmethod
    def bound(q: Node, d: Node) -> float:
        most = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        return most + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius) + 1e-6

    def visit(self, q: Node, d: Node) -> None:
        if self.bound(q, d) < self.worst[q.points].min():
            return
        if len(q.points) <= LEAF or not q.children:
            self.descend(q.points, d)
            return
        if q.radius >= d.radius / 2:
            for child in q.children:
                self.visit(child, d)
            if len(q.loose):
                self.descend(q.loose, d)
            return
        if len(d.loose):
            self.meet(q.points, d.loose)
        # The most promising child first, so that the k-th scores rise early.
        for most, at in sorted(((self.bound(q, child), at) for at, child in enumerate(d.children)), reverse=True):
            if most >= self.worst[q.points].min():
                self.visit(q, d.children[at])

    def descend(self, queries: np.ndarray, d: Node) -> None:
        """Each query by itself against the nodes below ``d``."""
        most = most_possible(self.fq[queries], d.centre[None, :], np.array([d.radius]))[:, 0]
        queries = queries[most >= self.worst[queries]]
        if not len(queries):
            return
        if len(d.loose):
            self.meet(queries, d.loose)
        if d.children:
            most = most_possible(self.fq[queries], d.centres, d.radii)
            for at in np.argsort(-most.max(axis=0)):
                left = queries[most[:, at] >= self.worst[queries]]
                if len(left):
                    self.descend(left, d.children[at])

    def meet(self, queries: np.ndarray, points: np.ndarray) -> None:
        scores = self.q[queries] @ self.x[points].T
        self.scored += scores.size
        reach = scores >= self.worst[queries][:, None]
        for row in np.flatnonzero(reach.any(axis=1)):
            query = queries[row]
            good = np.flatnonzero(reach[row])
            if len(good) > self.k + 1:
                # At most one of the points is the query's own row alone, so k others stand before all that is below.
                good = good[scores[row][good] >= np.sort(scores[row][good])[-self.k - 1]]
            found = self.best[query]
            own = self.uids[query]
            for at in good:
                score = int(scores[row][at])
                found += [(-score, i, uid) for i, uid in self.members[points[at]] if uid != own]
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.worst[query] = max(self.worst[query], not_above(-found[-1][0]))


FOUND = "uid long, query_id long, vec_id long, score long, scored long"


def matrix_of(values: pa.ChunkedArray | pa.Array, rows: int, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((rows, 1), np.int64)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy().reshape(rows, dim)


def search_group(data: pa.Table, queries: pa.Table) -> pa.Table:
    """Best candidates of one data block for one query block, and a row that only counts the pairs scored."""
    out: dict[str, list] = {"uid": [], "query_id": [], "vec_id": [], "score": [], "scored": []}
    if data.num_rows and queries.num_rows:
        dim = data["dim"][0].as_py()
        # Equal vectors are one point of the tree.
        points, place = np.unique(matrix_of(data["v"], data.num_rows, dim), axis=0, return_inverse=True)
        members: list[list[tuple[int, int]]] = [[] for _ in range(len(points))]
        ids, uids = data["id"].to_numpy(), data["uid"].to_numpy()
        for row in np.lexsort((uids, ids)):
            held = members[place.reshape(-1)[row]]
            if len(held) <= K:
                held.append((int(ids[row]), int(uids[row])))
        quids, qids = queries["uid"].to_numpy(), queries["id"].to_numpy()
        search = Search(matrix_of(queries["v"], queries.num_rows, dim), quids, points, members, K, queries["worst"].to_numpy())
        for at, found in enumerate(search.run()):
            for minus, vec_id, _ in found:
                out["uid"].append(int(quids[at]))
                out["query_id"].append(int(qids[at]))
                out["vec_id"].append(vec_id)
                out["score"].append(min(max(-minus, LOWEST), (1 << 63) - 1))
                out["scored"].append(None)
        for name in out:
            out[name].append(search.scored if name == "scored" else None)
    return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})


# -- the upper levels


def upper_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the upper levels of the cover tree of ``sample``: the widest node is opened until there are ``cells`` of them."""
    x = np.unique(sample, axis=0).astype(np.float64)
    heap = [(-np.inf, 0, cover_tree(x))]
    turn = 1
    while len(heap) < cells and heap[0][2].radius > 0:
        node = heapq.heappop(heap)[2]
        # A leaf's or a loose point is a node of its own. Rows near centres that find no room go to the nearest of the others.
        below = sorted(node.children, key=lambda child: -child.radius) + [Node(x[at], 0.0, np.array([at])) for at in node.loose]
        for child in below[: cells - len(heap)]:
            heapq.heappush(heap, (-child.radius, turn, child))
            turn += 1
    centres = np.stack([node.centre for _, _, node in heap])
    # Each centre moves to the middle of the sample's rows that are nearest to it, which makes its cell's radius smaller.
    near = np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T), axis=1)
    return np.stack([x[near == at].mean(axis=0) if (near == at).any() else c for at, c in enumerate(centres)])


def centres_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """The centres for each length of vectors, from a sample bounded in rows and in components."""
    sizes = rows.agg(F.max("dim")).first()[0]
    if sizes is None:
        return {}
    sample = bounded_sample(rows, max(1, min(SAMPLE, SAMPLE_VALUES // max(sizes, 1))), "upper levels", "uid")
    counts = {r["dim"]: r["n"] for r in rows.join(sample.select("dim").distinct(), "dim", "left_semi").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    table = sample.select("dim", "v").toArrow()
    dims = table["dim"].to_numpy()
    centres = {}
    for dim in np.unique(dims):
        mine = np.flatnonzero(dims == dim)
        cells = min(MAX_CELLS, len(mine) // CELL_SAMPLE, -(-counts[int(dim)] // CELL_ROWS))
        centres[int(dim)] = upper_centres(matrix_of(table["v"].take(pa.array(mine)), len(mine), int(dim)), max(1, cells))
    return centres


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by length, with their vectors as a matrix."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield int(dim), part, matrix_of(part.column("v"), part.num_rows, int(dim)).astype(np.float64)


def dealt(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the cell of each and its gap, the distance from the cell's centre."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_dim(batch):
                c = held.value.get(dim, np.zeros((1, x.shape[1])))
                cell = np.argmin(np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T), axis=1)
                gap = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                made = [pa.array(cell, pa.int32()), pa.array(gap, pa.float64())]
                yield pa.RecordBatch.from_arrays(part.columns + made, [*part.schema.names, "cell", "gap"])

    return rows.mapInArrow(run, "uid long, id long, dim int, v array<long>, cell int, gap double")


def sent(queries: DataFrame, centres: dict[int, np.ndarray], radii: dict[int, dict[int, float]], first: bool) -> DataFrame:
    """``queries`` (uid, id, dim, v, worst) with the cells they are sent to: those they probe first, or the others that can hold better scores."""
    held = queries.sparkSession.sparkContext.broadcast((centres, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = held.value
        for batch in batches:
            for dim, part, q in by_dim(batch):
                cells = np.array(sorted(radii[dim]), np.int64)
                c = centres.get(dim, np.zeros((1, q.shape[1])))[cells]
                scores = q @ c.T
                order = np.argsort(-scores, axis=1, kind="stable")
                chosen = np.zeros(scores.shape, bool)
                np.put_along_axis(chosen, order[:, :PROBES], True, axis=1)
                if not first:
                    worst = part.column("worst").to_numpy(zero_copy_only=False)[:, None]
                    chosen = ~chosen & (most_possible(q, c, np.array([radii[dim][i] for i in cells])) >= worst)
                made = pa.array([cells[row].tolist() for row in chosen], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "cells"])

    return queries.mapInArrow(run, "uid long, id long, dim int, v array<long>, worst double, cells array<int>")


def searched(celled: DataFrame, asked: DataFrame) -> DataFrame:
    """What the queries of ``asked`` (with ``cells``) find in their cells, as ``FOUND``."""
    asked = stored(asked, "asked").withColumn("cell", F.explode("cells"))
    loads = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("chunks"))
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # One row for each cell: MAX_CELLS at most for a length.
    parts = F.broadcast(loads.join(sizes, ["dim", "cell"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
    data = celled.join(parts, ["dim", "cell"]).withColumns({"d": own("blocks"), "q": every("chunks")})
    asked = asked.join(parts, ["dim", "cell"]).withColumns({"q": own("chunks"), "d": every("blocks")})
    keys = ["dim", "cell", "d", "q"]
    # Both come from one table; new names of columns keep them apart.
    data = data.select(*keys, "uid", "id", "v").toDF(*keys, "uid", "id", "v").groupBy(*keys)
    asked = asked.select(*keys, "uid", "id", "v", "worst").toDF(*keys, "uid", "id", "v", "worst").groupBy(*keys)
    return stored(data.cogroup(asked).applyInArrow(search_group, FOUND), "found")


def candidates(embeddings: DataFrame) -> DataFrame:
    """The k best of each query in each group it was sent to, and the pairs scored there, as ``FOUND``."""
    rows = stored(vectors(embeddings), "vectors")
    centres = centres_of(rows)
    celled = stored(dealt(rows, centres), "cells")
    radii: dict[int, dict[int, float]] = {}
    for r in celled.groupBy("dim", "cell").agg(F.max("gap").alias("radius")).collect():
        # With room for the rounding of the gaps.
        radii.setdefault(r["dim"], {})[r["cell"]] = r["radius"] * (1 + 1e-9)
    queries = celled.where(F.col("id") % QUERY_STEP == 0).select("uid", "id", "dim", "v")
    start = F.lit(float("-inf")).alias("worst")
    probed = searched(celled, sent(queries.select("*", start), centres, radii, True))
    turn = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score")))
    kth = probed.where("uid is not null").withColumn("turn", turn).where(F.col("turn") == K)
    # Doubles may round a score up; what was cut to 64 bits from below bounds nothing.
    slack = F.when(F.col("score").between(-(1 << 53), 1 << 53), F.lit(0.0)).otherwise(2048.0)
    kth = kth.select("uid", F.when(F.col("score") > LOWEST, F.col("score").cast("double") - slack).alias("kth"))
    asked = queries.join(kth, "uid", "left").select("uid", "id", "dim", "v", F.coalesce("kth", start).alias("worst"))
    return probed.unionByName(searched(celled, sent(asked, centres, radii, False)))


def top_k(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the ``K`` best candidates of each query."""
    found = candidates(embeddings).where("uid is not null")
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
