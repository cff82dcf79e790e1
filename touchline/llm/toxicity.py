"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

A text's features are the distinct hashes of its words, of neighbours, and of words with one between them, in
``2 ** BITS`` cells. Each cell has its own learning rate, and the L1 term keeps most weights at zero, so the model
is a short list of cells that every task holds.

Learning: the labelled rows, at most ``SAMPLE_ROWS`` of them by a hash of doc_id, are turned into features in parallel
and stored once. One task then runs FTRL over them, in the order of a hash and ``ROUNDS`` times, from one state to the
next, so that the evidence of every text counts in full and no cell is left out. Its work is bounded by the sample, its
memory by the cells: the features lie in a temporary file of the task.

Defined cases: null and empty texts have no feature and get the score of the bias alone. A null label, or one other
than 0 and 1, is no label; where a doc_id has several labels it is toxic if one says so. A null doc_id has no label
(nulls do not join). Without any labelled row, or with labels of one kind only, the model knows nothing and every
score is 0 (or 1, if all labels are 1). Repeated rows are scored row by row. Other columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import alnum_words, bounded_sample, id_remainder, per_row, short_batches, stored, utf8

BITS = 22
#: The bound on labelled rows to learn from.
SAMPLE_ROWS = 24_000
ROUNDS = 4

ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.1

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)

FEATURES = T.StructType([T.StructField("cells", T.BinaryType())])
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def cells_of(text: bytes | None) -> np.ndarray:
    """Cells of all features of a text, repeats included."""
    words = alnum_words(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    single = h * _PAIR
    pair = (single[:-1] ^ h[1:]) * _SKIP
    skip = (single[:-2] ^ (h[2:] << np.uint64(32))) * _PAIR
    return (np.concatenate((single * _SKIP, pair, skip)) >> _SHIFT).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Cells with a weight, in order, and the bias."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.cells] = self.weights
        return dense


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.abs(z) - L1
    return np.where(size > 0, -np.sign(z) * size / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def ftrl(rows: Iterable[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over rows of (places in the state, label); ``z`` and ``n`` change in place, the bias is last."""
    for at, label in rows:
        w = weights_of(z[at], n[at])
        w[-1] = -z[at[-1]] / ((BETA + np.sqrt(n[at[-1]])) / ALPHA)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        before = n[at]
        after = before + g * g
        z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        n[at] = after


LEARNED = "cells binary, weights binary, bias double"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all rows of (doc_id, toxic, cells, turn); no row without any."""
    with tempfile.TemporaryFile() as features:
        rows, end = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("turn", "doc_id", "toxic", "cells")]
            for turn, doc_id, toxic, cells in zip(*columns, strict=True):
                features.write(cells)
                # Rows with equal ids are put in order by their features.
                rows.append((turn, doc_id, zlib.crc32(cells), end, len(cells), toxic))
                end += len(cells)
        if not rows:
            return
        rows.sort()
        bias = 1 << BITS
        z, n = np.zeros(bias + 1), np.zeros(bias + 1)

        def in_order() -> Iterator[tuple[np.ndarray, int]]:
            for *_, start, length, toxic in rows:
                features.seek(start)
                yield np.append(np.frombuffer(features.read(length), np.int32), bias), toxic

        for _ in range(ROUNDS):
            ftrl(in_order(), z, n)
    w = weights_of(z[:-1], n[:-1])
    cells = np.flatnonzero(w).astype(np.int32)
    b = float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA))
    columns = [pa.array([x.tobytes()], pa.binary()) for x in (cells, w[cells].astype(np.float32))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([b])], ["cells", "weights", "bias"])


def labelled(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id that may be learned from."""
    return (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic in (0, 1) and doc_id is not null")
        .where(id_remainder(5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def sample_of(labels: DataFrame) -> DataFrame:
    """At most ``SAMPLE_ROWS`` labels, those with the lowest hashes of doc_id."""
    return bounded_sample(labels, SAMPLE_ROWS, "toxicity")


def train(documents: DataFrame, labels: DataFrame) -> Model:
    spark = documents.sparkSession
    short_batches(spark)
    sample = stored(sample_of(labelled(labels)), "labels")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 30.0 if 1 in counts else -1000.0)
    # The sample has SAMPLE_ROWS rows at most, so this side of the join is bounded.
    chosen = documents.select("doc_id", utf8().alias("text")).join(F.broadcast(sample), "doc_id")

    def compute():
        return lambda text: (np.unique(cells_of(text)).astype(np.int32).tobytes(),)

    rows = per_row(chosen, "text", compute, FEATURES, ["doc_id", "toxic"])
    # Of rows that share a doc_id one is learned from, that of the lowest hash, so that the bound holds for rows as for labels.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("cells").alias("hash"), "cells")).alias("low"))
    rows = rows.select("doc_id", "toxic", "low.cells")
    rows = stored(rows.withColumn("turn", F.xxhash64("doc_id", F.lit("order"))), "features")
    learned = rows.coalesce(1).mapInArrow(_learn, LEARNED).first()
    if learned is None:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 0.0)
    cells, weights = np.frombuffer(learned["cells"], np.int32), np.frombuffer(learned["weights"], np.float32)
    return Model(cells.astype(np.int64), weights, learned["bias"])


def score_text(text: bytes | None, table: np.ndarray, bias: float) -> float:
    cells = cells_of(text)
    cells = np.unique(cells[table[cells] != 0])
    margin = bias + float(table[cells].sum(dtype=np.float64))
    return float(1.0 / (1.0 + np.exp(-margin))) if margin > -500 else 0.0


def scores(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of each document's text."""
    spark = documents.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def compute():
        known = held.value
        table = known.table()
        return lambda text: (score_text(text, table, known.bias),)

    # The bytes travel under a name of their own, beside a text column that may be kept.
    rows = documents.withColumn("__utf8", utf8())
    return per_row(rows, "__utf8", compute, SCORE, keep)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = scores(documents, train(documents, labels), ["doc_id"])
    return scored.select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below one half."""
    names = documents.columns
    plain = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col("text"))
    scored = scores(plain, train(documents, labels), [f"k{i}" for i in range(len(names))])
    return scored.where("score < 0.5").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
