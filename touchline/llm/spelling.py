"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

A word's vector counts its letters. An inserted or deleted letter changes one count by one, a replaced one raises one count
and lowers another, so the L1 distance is at most two. For each length there is a tree over the words of that length; a word
searches the tree of its own length for vectors with at most one letter more and one letter fewer, and the tree of the next
length for vectors with one letter more. A box is left out when the excess over its sides is greater. What remains at the
leaves is verified letter by letter, in order.

The upper levels of a tree are split planes fitted on at most ``SAMPLE`` words (lowest hashes), which every task knows; they
deal all words to cells, and each word to every cell that its search reaches. Inside a cell a tree over all its words takes
over. Every word is indexed and every word searches: the sample decides on the cells only.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty text in the hash. Repeated rows count
again. Words of any length are compared whole. Ties of the form go to the smaller word in code point order. A word without
near words has none, form and form_n null, and itself as root; a root is reached as forms at least double n. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, id_text, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of this many runs one loses a letter.
DAMAGE = 97
MIN_LETTERS, MIN_COUNT = 5, 3

#: Words that the split planes are fitted on, at most; words of a cell, and of a leaf inside it, aimed at.
SAMPLE = 60_000
CELL, LEAF = 4096, 24
#: Pairs of words verified in one go.
PAIRS = 1 << 18


def vocabulary(documents: DataFrame) -> DataFrame:
    """word and n: the runs of letters, some with a letter deleted, that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = documents.select(id_text().alias("id"), F.explode(runs).alias("run"))
    h, length = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.length("run")
    at = (h % length).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    words = rows.select(F.when(h % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def codes(words: list[str]) -> np.ndarray:
    """A row of letters for each of the words, which are of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


#: a to z and the 64 letters from U+00C0 on.
LETTERS = 26 + 64


def counts(letters: np.ndarray) -> np.ndarray:
    """The letter-count vector of each row of letters."""
    place = np.where(letters >= 0xC0, letters.astype(np.int64) - 0xC0 + 26, letters.astype(np.int64) - 0x61)
    flat = place + np.arange(len(letters))[:, None] * LETTERS
    return np.bincount(flat.reshape(-1), minlength=len(letters) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


class Tree:
    """A k-d tree: nodes are (letter, most, left, right) with counts up to ``most`` on the left, or (leaf, points)."""

    def __init__(self, vectors: np.ndarray, leaf: int, depth: int = 64) -> None:
        self.leaves = 0
        self.root = self._grow(vectors, np.arange(len(vectors)), leaf, depth)

    def _grow(self, vectors: np.ndarray, points: np.ndarray, leaf: int, depth: int) -> tuple:
        if len(points) > leaf and depth:
            own = vectors[points]
            # The plane that divides most evenly: a letter, and its lowest or middle count.
            best = None
            for letter in np.argsort(-own.var(axis=0), kind="stable")[:8]:
                values = own[:, letter]
                most = int(np.median(values))
                for cut in (most, most - 1):
                    low = int((values <= cut).sum())
                    if 0 < low < len(points) and (best is None or abs(2 * low - len(points)) < best[0]):
                        best = abs(2 * low - len(points)), int(letter), cut
            if best:
                _, letter, cut = best
                low = own[:, letter] <= cut
                return letter, cut, self._grow(vectors, points[low], leaf, depth - 1), self._grow(vectors, points[~low], leaf, depth - 1)
        self.leaves += 1
        return self.leaves - 1, points

    def search(self, asked: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaves, their points, and the rows of ``asked`` whose search reaches them.

        A search allows ``more`` letters more than asked in all and ``fewer`` letters fewer; with 0 and 0 it finds the
        leaf of the vector itself.
        """
        free = (-1, 1 << 30)
        stack = [(self.root, np.arange(len(asked)), np.zeros(len(asked), np.int32), np.zeros(len(asked), np.int32), {})]
        while stack:
            node, rows, above, below, box = stack.pop()
            if not len(rows):
                continue
            if len(node) == 2:
                yield node[0], node[1], rows
                continue
            letter, cut, left, right = node
            low, high = box.get(letter, free)
            have = asked[rows, letter]
            # Excess of the box over the vector, and of the vector over the box, in this letter before and after the cut.
            down = below + np.maximum(have - cut, 0) - np.maximum(have - high, 0)
            up = above + np.maximum(cut + 1 - have, 0) - np.maximum(low - have, 0)
            keep = down <= fewer
            stack.append((left, rows[keep], above[keep], down[keep], {**box, letter: (low, cut)}))
            keep = up <= more
            stack.append((right, rows[keep], up[keep], below[keep], {**box, letter: (cut + 1, high)}))


def cell_trees(words: DataFrame) -> dict[int, Tree]:
    """The upper levels of the tree of each length."""
    sizes = {r["l"]: r["n"] for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n")).collect()}
    sample: dict[int, list[str]] = {}
    if any(n > CELL for n in sizes.values()):
        large = words.where(F.length("word").isin([length for length, n in sizes.items() if n > CELL]))
        for row in bounded_sample(large.select("word"), SAMPLE, "cells", "word").collect():
            sample.setdefault(len(row["word"]), []).append(row["word"])
    trees = {}
    for length, n in sizes.items():
        chosen = sorted(sample.get(length, []))
        vectors = counts(codes(chosen)) if chosen else np.zeros((0, LETTERS), np.int32)
        trees[length] = Tree(vectors, max(8, -(-len(chosen) * CELL // max(n, 1))))
    return trees


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Rows (length, cell, asks, word, n): each word in its own cell, and as a search in each cell it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            names, ns = batch.column("word").to_pylist(), np.array(batch.column("n").to_pylist(), np.int64)
            for i, name in enumerate(names):
                by_length.setdefault(len(name), []).append(i)
            for length, rows in by_length.items():
                own = [names[i] for i in rows]
                vectors, own_n, held = counts(codes(own)), ns[rows], pa.array(own)
                for at, more, fewer, asks in ((length, 0, 0, False), (length, 1, 1, True), (length + 1, 1, 0, True)):
                    if at not in trees:
                        continue
                    for cell, _, found in trees[at].search(vectors, more, fewer):
                        k = len(found)
                        columns = [
                            pa.array(np.full(k, at, np.int32)),
                            pa.array(np.full(k, cell, np.int32)),
                            pa.array(np.full(k, asks)),
                            held.take(pa.array(found)),
                            pa.array(own_n[found]),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "asks", "word", "n"])

    return words.mapInArrow(run, "length int, cell int, asks boolean, word string, n long")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``b``, one letter longer, is the row of ``a`` with one letter inserted."""
    length = a.shape[1]
    same, shifted = a == b[:, :length], a == b[:, 1:]
    before = np.where(same.all(axis=1), length, np.argmin(same, axis=1))
    after = np.where(shifted.all(axis=1), length, np.argmin(shifted[:, ::-1], axis=1))
    return before + after >= length


PAIR = "word string, near string, near_n long"


def near_in_cell(table: pa.Table) -> pa.Table:
    """Near words in a cell, as rows from either side; those of one length come from each side's own search."""
    kind = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    asks = table["asks"].to_numpy()
    names, ns = table["word"].to_numpy(zero_copy_only=False), table["n"].to_numpy()
    held = np.flatnonzero(~asks)
    out: list[pa.Table] = []
    if len(held):
        length = table["length"][0].as_py()
        letters = codes([names[i] for i in held])
        tree = Tree(counts(letters), LEAF)
        lengths = np.array([len(w) for w in names])
        for of, more, fewer in ((length, 1, 1), (length - 1, 1, 0)):
            searches = np.flatnonzero(asks & (lengths == of))
            if not len(searches):
                continue
            own = codes([names[i] for i in searches])
            check = one_replaced if of == length else one_inserted
            for _, points, rows in tree.search(counts(own), more, fewer):
                step = max(1, PAIRS // max(1, len(points) * length))
                for begin in range(0, len(rows), step):
                    part = rows[begin : begin + step]
                    left, right = np.repeat(part, len(points)), np.tile(points, len(part))
                    good = check(own[left], letters[right])
                    a, b = searches[left[good]], held[right[good]]
                    if not len(a):
                        continue
                    out.append(pa.table([pa.array(names[a]), pa.array(names[b]), pa.array(ns[b])], schema=kind))
                    if of != length:
                        out.append(pa.table([pa.array(names[b]), pa.array(names[a]), pa.array(ns[a])], schema=kind))
    return pa.concat_tables(out) if out else kind.empty_table()


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n for every ordered pair of near words of a table of distinct words."""
    cells = dealt(words, cell_trees(words))
    return cells.groupBy("length", "cell").applyInArrow(near_in_cell, PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """word and the last word of its chain of forms, for a table (word, form) in which chains end."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = stored(vocabulary(documents), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    rows = words.join(best, "word", "left")
    fits = -F.col("best.minus") >= 2 * F.col("n")
    rows = rows.select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    rows = stored(rows, "near")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
