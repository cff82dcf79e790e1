"""Exact n-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with the same set form a class; classes link
when 100 * intersection >= 75 * union, and the answer is the connected components of these links.

1. *Rare prefixes.* Of a set with n hashes the smallest ``n - ceil(3n/4) + ceil(n/8)`` are its prefix. If two sets link, at
   least ``ceil(ceil(3n/4)/8)`` of each one's prefix hashes lie in the other's prefix too. A class with fewer prefix hashes that
   any other class has links with nothing, and leaves. This drops documents that only share a passage.
2. *Candidate groups.* Among the shared prefix hashes, rarest first, two linked sets meet in all but the last of
   those that they must share. Classes connected through such hashes form a candidate group; no link leaves a group.
3. *Signature trees.* A group is joined in blocks of bounded size. A block's tree has class bitmaps (a bit per hash value) as leaves;
   inner nodes hold the OR of their children, the range of set sizes and the largest number of hashes lost to
   shared bits. A dual traversal drops a pair of nodes if the bits in common and the sizes cannot reach the needed overlap, or if their members are
   connected already; pairs of leaves that are left are compared exactly.
4. *Large groups.* A group of several blocks is joined within its blocks first; then the representatives of what was connected are joined in
   fewer blocks, until one is left. If that leaves a group in several parts, its hashes are put in order, those of one part first, then the rarest
   in the group: two linked sets share one of their first ``n - ceil(3n/4) + 1``. Classes connected through such hashes of more than one part
   form narrower groups, which are joined in the same way. Only if one of these is left in several parts, all pairs of its blocks are traversed.

Disk: prefixes lie in ``PARTS`` columns by key, so that keys are counted and joined part by part; groups, too, are joined in parts where they hold much of the
input. Shuffle files of a part go before the next, and tables between steps when no step reads them, so that the largest shuffle is a share of the input.

Class ids and hashes have 64 bits; unequal ones meet with a probability near 2**-64 a pair. Prefix hashes carry 48 bits, which can
only add candidates. Nothing is capped: long, frequent and repeated sets take the same way.

Defined cases: null and empty texts, and those of blanks only, have 0 shingles and stay alone: their component is their own doc_id.
A text of one to four words is one shingle of all its words. Rows alike in text are one class, also with the same or a null doc_id; null ids do
not count for the smallest, and a component of null ids only has a null component_id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import SPACED_WORD, Tables, short_batches, spaced_words, utf8
from touchline.llm.components import components

SHINGLE = 5
#: Bounds of a block: classes, and hashes of all its classes.
BLOCK_CLASSES = 1024
BLOCK_HASHES = 1 << 20
#: Columns that a prefix is dealt to, and so the most parts of a step; and the keys that a part is worth being made for.
PARTS = 8
PART_KEYS = 1 << 23
#: Hashes that one task counts at a time.
PART_ROWS = 1 << 18
#: Groups are joined in parts that hold this share of the input's hashes or less.
GROUPS_SHARE = 0.25
#: Up to so many texts to read again are found by a broadcast of their hashes, beyond by a join.
BROADCAST_TEXTS = 2_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, np.uint64(size))
    for i in range(size):
        mixed = (mixed * _A) ^ h[i : i + count]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _B
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def class_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + -(-n // 8)


def prefix_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes[: prefix_length(len(hashes))] >> np.uint64(16)).astype(np.int64)


def parts_for(keys: int) -> int:
    return max(1, min(PARTS, -(-keys // PART_KEYS)))


def part_of(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), column), F.lit(parts))


# -- one row per document


PREFIX = [f"p{i}" for i in range(PARTS)]


def sets_of(documents: DataFrame) -> DataFrame:
    """doc_id, text hash, class, set size and, at a class's first row in a task, its prefix, dealt to columns by the keys' remainders."""
    short_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), utf8().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, prefixes = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text)
                cls = class_id(hashes) if len(hashes) else None
                ids.append(cls)
                sizes.append(len(hashes))
                prefixes.append(np.empty(0, np.int64) if cls is None or cls in seen else prefix_of(hashes))
                seen.add(cls)
            keys = np.concatenate([np.empty(0, np.int64), *prefixes])
            row = np.repeat(np.arange(len(ids)), [len(p) for p in prefixes])
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            for i in range(PARTS):
                own = keys % PARTS == i
                ends = np.append(0, np.bincount(row[own], minlength=len(ids)).cumsum()).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[own], pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "cls", "n", *PREFIX])

    return rows.mapInArrow(run, "doc_id long, th long, cls long, n long, " + ", ".join(f"{p} array<long>" for p in PREFIX))


def shared_keys(rows: DataFrame) -> DataFrame:
    """Of cls, n and key, the rows of keys that more than one class has, with the number of rows of the key."""
    ends = rows.groupBy("key").agg(F.count("*").alias("df"), F.min("cls").alias("first"), F.max("cls").alias("last"))
    return rows.join(ends.where("first < last").select("key", "df"), "key").select("cls", "n", "key", "df")


def candidate_keys(sets: DataFrame, tables: Tables) -> DataFrame:
    """cls, n, and the prefix hashes by which a class can meet those it links with; classes without a chance are left out."""
    # A prefix has three eighths of its set.
    parts = parts_for((sets.where("cls is not null").agg(F.sum("n")).first()[0] or 0) * 3 // 8)
    explode = [sets.select("cls", "n", F.explode(F.concat(*PREFIX[i::parts])).alias("key")) for i in range(parts)]
    shared = tables.put("shared", (shared_keys(rows) for rows in explode), parts)
    least = F.ceil(F.ceil(3 * F.col("n") / 4) / 8).cast("int")

    def held(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("cls").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "key"))).alias("keys"))
        rows = rows.where(F.size("keys") >= least)
        return rows.select("cls", "n", F.slice("keys", 1, F.size("keys") - least + 1)["key"].alias("keys"))

    parts = parts_for(shared.count())
    keys = tables.put("keys", (held(shared.where(part_of("cls", parts) == i)) for i in range(parts)), parts)
    tables.drop("shared")
    return keys


def candidate_groups(keys: DataFrame, tables: Tables) -> DataFrame:
    """cls and grp: classes connected through candidate keys."""
    parts = parts_for(keys.agg(F.sum(F.size("keys"))).first()[0] or 0)
    rows = keys.select("cls", F.explode("keys").alias("key"))

    def edges(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first < last")
        return rows.join(ends, "key").select(F.col("cls").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()

    met = tables.put("met", (edges(rows.where(part_of("key", parts) == i)) for i in range(parts)), parts)
    groups = components(met, tables)
    tables.drop("met")
    return groups.select(F.col("node").alias("cls"), F.col("component").alias("grp"))


def members_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """grp, cls, n and all hashes of the classes wanted (cls, th, grp); their texts are read once more."""
    texts = wanted.select("th").distinct()
    if wanted.count() <= BROADCAST_TEXTS:
        texts = F.broadcast(texts)
    short_batches(documents.sparkSession)
    rows = documents.select(F.xxhash64("text").alias("th"), utf8().alias("text")).join(texts, "th", "left_semi")
    # Texts are shorter than their hashes, so texts are shuffled.
    rows = rows.dropDuplicates(["th"]).join(wanted.select("th", "cls", "grp"), "th").select("grp", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array(map(len, found), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("cls"), *columns], ["grp", "cls", "n", "hashes"])

    return rows.mapInArrow(run, "grp long, cls long, n long, hashes binary")


# -- signature trees

FANOUT = 8


class SignatureTree:
    """Classes of one block in levels of nodes, ``FANOUT`` children each; level 0 are the classes."""

    def __init__(self, hashes: list[np.ndarray]) -> None:
        sizes = np.array([len(h) for h in hashes], np.int64)
        # Near copies tend to have the same smallest hash, so they come to lie in the same nodes.
        self.order = np.lexsort((sizes, np.array([h[0] for h in hashes], np.uint64)))
        self.hashes = [hashes[i] for i in self.order]
        width = 256
        while width < min(8 * sizes.max(), 1 << 17):
            width *= 2
        bits = np.zeros((len(hashes), width // 64), np.uint64)
        for row, values in zip(bits, self.hashes, strict=True):
            flags = np.zeros(width, bool)
            flags[(values & np.uint64(width - 1)).astype(np.int64)] = True
            row[:] = np.packbits(flags).view(np.uint64)
        sizes = sizes[self.order]
        lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, lost)]
        while len(bits) > 1:
            starts = np.arange(0, len(bits), FANOUT)
            low, high, lost = self.levels[-1][1:]
            bits = np.bitwise_or.reduceat(bits, starts, axis=0)
            levels = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(lost, starts)
            self.levels.append((bits, *levels))


def may_link(level: tuple, left: slice, right: slice) -> np.ndarray:
    """Which pairs of nodes can hold linked classes, by bits in common, sizes and hashes lost to shared bits."""
    bits, low, high, lost = level
    common = np.bitwise_count(bits[left, None, :] & bits[None, right, :]).sum(axis=2, dtype=np.int64)
    overlap = common + np.minimum(lost[left, None], lost[None, right])
    overlap = np.minimum(overlap, np.minimum(high[left, None], high[None, right]))
    needed = -(-3 * (low[left, None] + low[None, right]) // 7)
    apart = (4 * high[left, None] < 3 * low[None, right]) | (4 * high[None, right] < 3 * low[left, None])
    return (overlap >= needed) & ~apart


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def join_block(hashes: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Labels after a block's links are followed: classes with equal labels are connected (before as after)."""
    tree = SignatureTree(hashes)
    now = labels[tree.order].copy()

    def visit(level: int, i: int, j: int) -> None:
        span = FANOUT ** (level + 1)
        left, right = now[i * span : (i + 1) * span], now[j * span : (j + 1) * span]
        if (left == left[0]).all() and (right == left[0]).all():
            return
        below = tree.levels[level]
        at_i, at_j = slice(i * FANOUT, (i + 1) * FANOUT), slice(j * FANOUT, (j + 1) * FANOUT)
        pairs = np.argwhere(may_link(below, at_i, at_j))
        # Children paired with themselves come first: what they connect need not be searched again.
        pairs = sorted((a + i * FANOUT, b + j * FANOUT) for a, b in pairs.tolist())
        for a, b in sorted(pairs, key=lambda p: p[0] != p[1]):
            if i == j and a > b:
                continue
            if level:
                visit(level - 1, a, b)
            elif now[a] != now[b] and linked(tree.hashes[a], tree.hashes[b]):
                old, new = max(now[a], now[b]), min(now[a], now[b])
                now[now == old] = new

    if len(hashes) > 1:
        visit(len(tree.levels) - 2, 0, 0)
    out = np.empty_like(now)
    out[tree.order] = now
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """Rows of (cls, label, hashes) that follow each other with equal keys."""
    held, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in [*keys, "cls", "label", "hashes"]]
        for values in zip(*columns, strict=True):
            key = values[: len(keys)]
            if key != held:
                if rows:
                    yield held, rows
                held, rows = key, []
            rows.append(values[len(keys) :])
    if rows:
        yield held, rows


def joined(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """cls, label before and label after the join of each block; ``blocks`` has keys, cls, label, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, keys):
            ids, labels, hashes = zip(*rows, strict=True)
            after = join_block([np.frombuffer(h, np.uint64) for h in hashes], np.array(labels, np.int64))
            columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "before", "after"])

    rows = blocks.select(*keys, "cls", "label", "hashes").repartition(*keys).sortWithinPartitions(*keys, "cls")
    return rows.mapInArrow(run, "cls long, before long, after long")


def _in_blocks(items: DataFrame) -> DataFrame:
    """Items with the number of blocks of their group, and their own block."""
    needed = items.groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("blocks")
    )
    # Only full blocks make a group have several, so these groups are few.
    rows = items.join(F.broadcast(needed.where("blocks > 1")), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))


def connected(members: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """cls, grp and label of all members, joined within blocks and through representatives; and the groups that this leaves in several parts."""
    items = members.withColumn("label", F.col("cls"))
    labels, several = None, None
    while True:
        # Nearly all groups are done after one round; the rest goes on with one class for each label.
        blocks = _in_blocks(items)
        passed = joined(blocks, ["grp", "block"]).join(blocks.select("cls", "grp", "blocks"), "cls")
        passed = tables.put("passed", passed)
        if labels is None:
            labels = passed.select("cls", "grp", F.col("after").alias("label"))
            several = tables.put("several", passed.where("blocks > 1").select("grp").distinct())
        else:
            step = passed.select(F.col("cls").alias("label"), "after")
            labels = labels.join(step, "label", "left").select("cls", "grp", F.coalesce("after", "label").alias("label"))
        labels = tables.put("labels", labels)
        open_groups = passed.where("blocks > 1").groupBy("grp").agg(F.count_distinct("after").alias("now"), F.count("*").alias("was"))
        # A group goes on as long as a round at least halves it.
        open_groups = tables.put("open", open_groups.where("now > 1 and 2 * now <= was"))
        if open_groups.isEmpty():
            break
        own = F.broadcast(open_groups.select("grp"))
        heads = passed.where("cls = after").join(own, "grp").select("cls")
        items = tables.put("heads", members.join(own, "grp").join(heads, "cls").withColumn("label", F.col("cls")))
    parted = labels.join(F.broadcast(several), "grp").groupBy("grp").agg(F.count_distinct("label").alias("parts")).where("parts > 1")
    parted = tables.put("parted", parted.select("grp"))
    tables.drop("passed", "several", "open", "heads")
    return labels, parted


HELD = ["grp", "cls", "label", "n"]


def _dealt(values: np.ndarray, by: np.ndarray, parts: int) -> pa.RecordBatch:
    """The columns of ``values`` as one row of bytes for each part, dealt by the hashes ``by``."""
    part = (by.view(np.uint64) * _A >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    starts = np.append(np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts))), len(order))
    rows = [np.ascontiguousarray(values[:, order[i:j]]).tobytes() for i, j in itertools.pairwise(starts)]
    return pa.RecordBatch.from_arrays([pa.array(part[order[starts[:-1]]].astype(np.int64)), pa.array(rows, pa.binary())], ["part", "rows"])


def _parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """The columns of each part, whose rows follow each other."""
    pairs = (p for batch in batches for p in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True))
    for _, rows in itertools.groupby(pairs, key=lambda p: p[0]):
        yield np.concatenate([np.frombuffer(r, np.int64).reshape(columns, -1) for _, r in rows], axis=1)


def rarest_hashes(members: DataFrame, parts: int) -> DataFrame:
    """grp, cls, label and key: of the hashes that each class has, those by which it must meet a class of another label that it links with.

    Hashes of one label come first in the order, then those of few classes; the first ``n - ceil(3n/4) + 1`` are taken, of which the
    former are left out. Hashes travel as bytes, a row for each part of a batch.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(h, np.int64) for h in batch.column("hashes").to_pylist()]
            sizes = np.array([len(h) for h in hashes], np.int64)
            held = [batch.column(c).to_numpy() for c in HELD]
            # Long sets of a batch go in several steps.
            for _, rows in itertools.groupby(range(len(sizes)), key=(sizes.cumsum() // PART_ROWS).__getitem__):
                rows = list(rows)
                key = np.concatenate([hashes[i] for i in rows])
                columns = [np.repeat(h[rows], sizes[rows]) for h in held]
                yield _dealt(np.array([*columns, key]), key ^ columns[0], parts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _parts(batches, 5):
            grp, _, label, _, key = values
            values = values[:, np.lexsort((key, grp))]
            grp, cls, label, _, key = values
            starts = np.flatnonzero(np.append(True, (np.diff(grp) != 0) | (np.diff(key) != 0)))
            df = np.diff(np.append(starts, len(key)))
            several = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
            met = np.repeat(several, df)
            if met.any():
                yield _dealt(np.vstack((values, np.repeat(df, df)))[:, met], cls[met], parts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _parts(batches, 6):
            _, cls, _, _, key, df = values
            values = values[:, np.lexsort((key, df, cls))]
            cls, n = values[1], values[3]
            starts = np.flatnonzero(np.append(True, np.diff(cls) != 0))
            sizes = np.diff(np.append(starts, len(cls)))
            rank = np.arange(len(cls)) - np.repeat(starts, sizes)
            taken = rank < np.repeat(sizes, sizes) + (-3 * n // 4) + 1
            columns = [pa.array(values[i, taken]) for i in (0, 1, 2, 4)]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "cls", "label", "key"])

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "part").sortWithinPartitions("part")

    dealt = "part long, rows binary"
    rows = by_part(members.select(*HELD, "hashes").mapInArrow(exploded, dealt)).mapInArrow(counted, dealt)
    return by_part(rows).mapInArrow(first, "grp long, cls long, label long, key long")


def narrower_groups(members: DataFrame, tables: Tables) -> DataFrame:
    """cls and grp: classes of a group that meet in the rarest hashes of those with several labels; classes that can only link with their own label are left out."""
    short_batches(members.sparkSession)
    hashes = members.agg(F.sum("n")).first()[0]
    rarest = tables.put("rarest", rarest_hashes(members, -(-hashes // PART_ROWS)))

    def edges(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("grp", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("cls").alias("first"))
        met = rows.join(ends.where("low < high"), ["grp", "key"])
        return met.select(F.col("cls").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()

    parts = parts_for(rarest.count())
    met = tables.put("met", (edges(rarest.where(part_of("key", parts) == i)) for i in range(parts)), parts)
    groups = components(met, tables).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    tables.drop("rarest", "met")
    return groups


def links_of_blocks(members: DataFrame) -> DataFrame:
    """a and b: labels that links connect, over all pairs of blocks of each group."""
    rest = _in_blocks(members)
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    paired = rest.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn(
        "j", F.greatest("block", "other")
    )
    links = joined(paired.where("i < j or blocks = 1"), ["grp", "i", "j"]).where("before <> after")
    return links.select(F.col("before").alias("a"), F.col("after").alias("b"))


def labels_of(members: DataFrame, tables: Tables) -> DataFrame:
    """cls and label of all members; equal labels are connected by links, others are not."""
    labels, parted = connected(members, tables)
    if parted.isEmpty():
        return labels.select("cls", "label")
    labels = tables.put("labels_before", labels.select("cls", "label"))
    rest = tables.put("rest", members.join(F.broadcast(parted), "grp").join(labels, "cls"))
    groups = narrower_groups(rest, tables)
    rest = tables.put("rest", rest.drop("grp", "label").join(groups, "cls"))
    again, parted = connected(rest, tables)
    # A label is a class, whose own row ties it to its label before.
    met = [again.join(labels.withColumnRenamed("label", "a"), "cls").select("a", F.col("label").alias("b"))]
    if not parted.isEmpty():
        met.append(links_of_blocks(rest.join(F.broadcast(parted), "grp").join(again.select("cls", "label"), "cls")))
    final = components(tables.put("met", met), tables)
    tables.drop("rest", "met")
    labels = labels.join(final.select(F.col("node").alias("label"), "component"), "label", "left")
    return labels.select("cls", F.coalesce("component", "label").alias("label"))


# -- results


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, th, n and the component label of every document with shingles; the label is null without any."""
    tables = Tables(documents.sparkSession, "jaccard")
    sets = tables.put("sets", sets_of(documents))
    keys = candidate_keys(sets, tables)
    ids = tables.put("ids", sets.select("doc_id", "th", "cls", "n"))
    tables.drop("sets")
    groups = candidate_groups(keys, tables)
    tables.drop("keys")
    wanted = ids.where("cls is not null").groupBy("cls").agg(F.min("th").alias("th"), F.max("n").alias("n")).join(groups, "cls")
    wanted = tables.put("wanted", wanted)
    total, held = ((rows.agg(F.sum("n")).first()[0] or 0) for rows in (ids, wanted))
    parts = max(1, min(parts_for(held), math.ceil(held / max(GROUPS_SHARE * total, 1))))

    def found() -> Iterator[DataFrame]:
        for i in range(parts):
            members = tables.put("members", members_of(documents, wanted.where(part_of("grp", parts) == i)))
            yield labels_of(members, tables)

    labels = tables.put("found", found())
    alone = ids.where("cls is null").select("doc_id", "th", "n", F.lit(None).cast("long").alias("label"))
    rows = ids.where("cls is not null").select("doc_id", "th", "n", "cls").join(labels, "cls", "left")
    rows = rows.select("doc_id", "th", "n", F.coalesce("label", "cls").alias("label")).unionByName(alone)
    rows = tables.put("classes", rows)
    tables.keep("classes")
    return rows


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = classes(documents)
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    many = rows.where("label is not null").join(smallest, "label")
    alone = rows.where("label is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return many.select(*columns).unionByName(alone.select(*columns))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are the first of their component; those without a word all stay."""
    names = documents.columns
    rows = classes(documents).where("label is not null")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    first = first.select(F.col("f.none").alias("none"), F.coalesce("f.doc_id", F.lit(0)).alias("key"), F.col("f.th").alias("hash"))
    key = F.col("doc_id").cast("long")
    plain = documents.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)],
        key.isNull().alias("none"),
        F.coalesce(key, F.lit(0)).alias("key"),
        F.xxhash64("text").alias("hash"),
        F.coalesce(F.col("text").rlike(SPACED_WORD), F.lit(False)).alias("worded"),
    )
    # The columns of the join are plain, so that the rows lie for the window as they do for the join: texts are shuffled once.
    same = ["none", "key", "hash"]
    kept = plain.where("worded").join(first, same)
    turn = F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0)))
    kept = kept.withColumn("turn", turn).where("turn = 1")
    columns = [F.col(f"k{i}").alias(c) for i, c in enumerate(names)]
    return kept.select(*columns).unionByName(plain.where("not worded").select(*columns))
