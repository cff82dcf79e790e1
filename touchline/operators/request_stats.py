"""Labelled counters, error rates and fixed-bucket histograms over log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_template(path: Column) -> Column:
    """Path with the match identifier replaced, so that labels stay few."""
    return F.regexp_replace(path, r"\A(/api/matches/)[^/]+(/|\z)", "$1{matchId}$2")


def labelled_counts(rows: DataFrame, *labels: str, name: str = "total") -> DataFrame:
    """Rows per combination of labels."""
    return rows.groupBy(*labels).agg(F.count("*").alias(name))


def error_rate(requests: DataFrame, *labels: str) -> DataFrame:
    """Requests, server errors (status 500 and above) and their share."""
    failed = F.count_if(F.col("status") >= 500)
    return requests.groupBy(*labels).agg(
        F.count("*").alias("requests"), failed.alias("errors"), (failed / F.count("*")).alias("error_rate")
    )


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram: one row per group and upper bound ``le``, ``+Inf`` included.

    Every row also carries the group's ``value_sum`` and ``value_count``.  All bounds are
    counted in one aggregation, which combines on the map side.  NaN is no measurement and
    is left out like NULL.
    """
    x = F.col(value)
    if rows.schema[value].dataType.typeName() in ("double", "float"):
        x = F.nanvl(x, F.lit(None).cast("double"))
    totals = rows.groupBy(*by).agg(
        F.sum(x).alias("value_sum"),
        F.count(x).alias("value_count"),
        *[F.count_if(x <= bound).alias(f"_le_{i}") for i, bound in enumerate(bounds)],
    )
    buckets = F.array(
        *[
            F.struct(F.lit(str(bound)).alias("le"), F.col(f"_le_{i}").alias("bucket_count"))
            for i, bound in enumerate(bounds)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("value_count").alias("bucket_count")),
    )
    return totals.select(*by, F.inline(buckets), "value_sum", "value_count")
