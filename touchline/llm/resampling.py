"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The features of a text are its words and word pairs (A-Z in lower case, punctuation kept, since junk shows in it), hashed into
``2 ** BITS`` cells. Two generative models give each cell a smoothed probability: the raw one from the cells of
all documents, the target one from texts labelled as good, at most ``SAMPLE_ROWS`` of them by a hash of doc_id. A document's weight is the log
of its importance: the probability of all its features in the target model over that in the raw one, that is the sum of their log ratios,
divided by ``TEMPERATURE``.
Gumbel noise from a hash of the document makes the ``fraction`` with the largest sums a sample without replacement in proportion to
the weights' exponentials. The k-th largest sum is found by counting in ever finer steps, never by ordering the table.

Defined cases: null and empty texts have no feature and the lowest weight, NO_FEATURES; they are chosen only after all others. Equal sums are chosen by doc_id (null last), then text hash; rows
alike in both are chosen together as long as they fit, and the first of them beyond. A null label or one other than 1 is not a target; without target rows all weights are 0
and the sample is uniform. Repeated rows count each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import bounded_sample, id_text, per_row, short_batches, spaced_words, stored, utf8

BITS = 16
SAMPLE_ROWS = 20_000
#: The part of the documents to choose: about the part of the labelled ones that are good.
FRACTION = 0.85
#: 1 samples in proportion to the ratio of the two models; more makes the sample more even.
TEMPERATURE = 1.0
#: Observations that the raw model is worth in the target model, in every cell's proportion.
PRIOR = 1 << BITS
#: Below the weight of any text: 2 ** 31 features of a log ratio of 100 stay above.
NO_FEATURES = -1e12

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def cells_of(text: bytes | None) -> np.ndarray:
    words = spaced_words(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    single = h * _PAIR
    pair = (single[:-1] ^ h[1:]) * _PAIR
    return (np.concatenate((single, pair)) >> _SHIFT).astype(np.int64)


def cell_counts(texts: DataFrame) -> DataFrame:
    """cell and n over all texts; each task hands on one row for each cell."""
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(cells_of(text), minlength=1 << BITS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counted = texts.select(utf8().alias("text")).mapInArrow(run, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame) -> np.ndarray:
    """Counts by cell, a bounded number of them."""
    out = np.zeros(1 << BITS)
    table = counts.toArrow()
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out


def targets_of(labels: DataFrame) -> DataFrame:
    """doc_id of good texts, at most ``SAMPLE_ROWS``: those with the lowest hashes."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return bounded_sample(good, SAMPLE_ROWS, "target")


def log_ratio(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log of target to raw probability for each cell."""
    raw = dense(cell_counts(documents)) + 1.0
    raw /= raw.sum()
    # SAMPLE_ROWS bounds this side of the join.
    target = dense(cell_counts(documents.join(F.broadcast(stored(targets_of(labels), "targets")), "doc_id", "left_semi")))
    target += PRIOR * raw
    return np.log(target / target.sum() / raw)


WEIGHT = T.StructType([T.StructField("weight", T.DoubleType())])


def weights(documents: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, th (text hash) and weight of every document."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(log_ratio(documents, labels))
    short_batches(spark)

    def compute():
        ratio = held.value

        def one(text: bytes | None) -> tuple[float]:
            cells = cells_of(text)
            return (float(ratio[cells].sum()) / temperature if len(cells) else NO_FEATURES,)

        return one

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), utf8().alias("text")
    )
    return per_row(rows, "text", compute, WEIGHT, ["doc_id", "th"])


def gumbel(seed: str):
    """Standard Gumbel noise from a hash of doc_id and text."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), id_text(), F.col("th")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


STEPS = 1 << 12


def cut(rows: DataFrame, column: str, k: int) -> tuple[float, float]:
    """Bounds low <= high: all above high are among the k largest, and the k-th lies between (ends included).

    Each round counts rows in ``STEPS`` equal steps of the interval and goes on with the step that holds the k-th.
    """
    ends = rows.agg(F.min(column), F.max(column)).first()
    low, high, above = ends[0], ends[1], 0
    while low < high:
        width = (high - low) / STEPS
        if low + width <= low or high - width >= high:
            break
        step = F.least(F.floor((F.col(column) - low) / width), F.lit(STEPS - 1)).cast("int")
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        found = {r["s"]: r for r in inside.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for s in sorted(found, reverse=True):
            if above + found[s]["n"] >= k:
                low, high = found[s]["a"], found[s]["b"]
                break
            above += found[s]["n"]
        if found[s]["n"] <= 1000:
            break
    return low, high


def resampled(documents: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: str = "resample-1", temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, weight, the sum that decides, and whether the document is in the sample."""
    scored = weights(documents, labels, temperature)
    scored = stored(scored.withColumn("rank_score", F.col("weight") + gumbel(seed)), "weights")
    k = int(round(scored.count() * fraction))
    if k == 0:
        return scored.select("doc_id", "weight", "rank_score", F.lit(False).alias("selected"))
    low, high = cut(scored, "rank_score", k)
    score = F.col("rank_score")
    above = scored.where(score > high)
    left = k - above.count()
    # Ties and what the steps could not tell apart: a few rows, unless a score is shared by many.
    between = scored.where((score >= low) & (score <= high))
    turn = _place(between)
    chosen = [
        above.withColumn("selected", F.lit(True)),
        turn.withColumn("selected", F.col("place") <= left).drop("place"),
        scored.where(score < low).withColumn("selected", F.lit(False)),
    ]
    every = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    return every.select("doc_id", "weight", "rank_score", "selected")


def _place(rows: DataFrame) -> DataFrame:
    """Places from the largest score on; ties are dealt by hash bucket first, so that no tie meets in one task."""
    order = [F.desc("rank_score"), F.col("doc_id").asc_nulls_last(), F.col("th")]
    span = F.floor(F.coalesce(F.col("doc_id"), F.lit((1 << 62))) / 4096)
    keys = rows.withColumn("span", span)
    sizes = keys.groupBy("rank_score", "span").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(F.desc("rank_score"), "span").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("rank_score").alias("r"), F.col("span").alias("s"), F.coalesce(before, F.lit(0)).alias("first"))
    joined = keys.join(starts, (F.col("rank_score") == F.col("r")) & (F.col("span") == F.col("s")))
    inside = F.row_number().over(W.partitionBy("rank_score", "span").orderBy(*order))
    return joined.withColumn("place", F.col("first") + inside).drop("r", "s", "first", "span")
