"""Histograms by minute whose cells add up, and percentiles of any range of time out of them.

A cell counts the values of one logarithmic bucket: the bucket of x is the sign of x and the least whole k with
``growth ** k >= |x|``, where ``growth`` is (1 + error) / (1 - error). The middle of a bucket is at most ``error``, relative to the value, away
from every value in it. Cells of different minutes, labels or batches add up by bucket without further error, and a group has
no more buckets than its values have orders of magnitude times a few hundred, so merged cells are small whatever they count.

NULL, NaN and infinite values are no measurements and are left out, as is a row without a time.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.sources.commits import CommittedTable

#: Distance of a percentile from the exact one, relative to that.
ERROR = 0.01

_BUCKET = ("sign", "bucket")


def growth(error: float = ERROR) -> float:
    if not 0 < error < 1:
        raise ValueError(f"a relative error lies between 0 and 1, not at {error}")
    return (1 + error) / (1 - error)


def middle_of(sign: Column, bucket: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    return sign * 2 * F.pow(F.lit(growth(error)), bucket) / (growth(error) + 1)


def histogram_cells(rows: DataFrame, value: str, time: str, by: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """Rows counted by minute, labels and bucket, combined on the map side."""
    x = F.col(value).cast("double")
    measured = rows.filter(F.col(time).isNotNull() & (F.abs(x) < float("inf")))
    bucket = F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / math.log(growth(error))))
    return measured.groupBy(
        F.date_trunc("minute", F.col(time).cast("timestamp")).alias("minute"),
        *by,
        F.signum(x).cast("int").alias("sign"),
        bucket.cast("int").alias("bucket"),
    ).agg(F.count("*").alias("n"))


def merged(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells added up by bucket, over all minutes and over the labels that ``by`` leaves out."""
    return cells.groupBy(*by, *_BUCKET).agg(F.sum("n").alias("n"))


def percentiles_of(
    cells: DataFrame, percentiles: Mapping[str, float], by: Sequence[str] = (), error: float = ERROR
) -> DataFrame:
    """Per group the number of values and, for each percentile, what stands for the value of rank floor(p / 100 * (n - 1)), from 0.

    Only merged cells meet in a task: a group's buckets, not its values.
    """
    rank_of = {name: F.floor(F.lit(p) / 100 * (F.col("total") - 1)) for name, p in percentiles.items()}
    group = Window.partitionBy(*by)
    upward = group.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    placed = merged(cells, by).select(
        *by,
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(upward).alias("up_to"),
        middle_of(F.col("sign"), F.col("bucket"), error).alias("middle"),
    )
    found = [F.min(F.when(F.col("up_to") > rank, F.col("middle"))).alias(name) for name, rank in rank_of.items()]
    return placed.groupBy(*by, F.col("total").alias("n")).agg(*found)


class HistogramTable:
    """Stored cells by date; batches add their own, however late their rows are, and a repeated batch adds nothing."""

    def __init__(self, spark: SparkSession, path: str, labels: Sequence[str] = (), error: float = ERROR) -> None:
        self.labels, self.error = list(labels), error
        fields = [T.StructField("minute", T.TimestampType())]
        fields += [T.StructField(label, T.StringType()) for label in labels]
        fields += [T.StructField(name, T.IntegerType()) for name in _BUCKET]
        schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("cell_date", T.DateType())])
        self.table = CommittedTable(spark, path, schema, date_column="cell_date", cluster_by=("minute",))

    def add(self, rows: DataFrame, value: str, time: str, writer: str, batch: int) -> None:
        cells = histogram_cells(rows, value, time, self.labels, self.error)
        self.table.append(cells.withColumn("cell_date", F.to_date("minute")), writer, batch)

    def cells(self, since: str, until: str) -> DataFrame:
        """Cells of the minutes from ``since`` on and before ``until``; only the dates between them are opened."""
        minute = F.col("minute")
        held = self.table.read(since[:10], until[:10])
        return held.filter((minute >= F.lit(since).cast("timestamp")) & (minute < F.lit(until).cast("timestamp")))

    def fold(self, before: str | None = None) -> None:
        """Adds up the cells of each date, while batches go on."""

        def once(rows: DataFrame) -> DataFrame:
            return merged(rows, ["cell_date", "minute", *self.labels])

        self.table.compact(before, once)
