"""Exact percentiles with linear interpolation between neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numbers import interpolate, rank_position
from touchline.operators.newest import newest
from touchline.schema import LATENCY_WINDOW
from touchline.session import new_run_dir

LATENCY_PERCENTILES = {"p50": 50, "p95": 95, "p99": 99}


def latency_percentiles(
    samples: DataFrame,
    by: Sequence[str] = (),
    value: str = "duration_ms",
    order: Sequence[str] = ("ts", "seq"),
    n: int = LATENCY_WINDOW,
    whole_ms: bool = True,
    percentiles: Mapping[str, float] = LATENCY_PERCENTILES,
) -> DataFrame:
    """Percentiles over the newest ``n`` samples; no row when there are no samples.

    ``whole_ms`` drops the fraction of each sample first.
    """
    sample = F.floor(value).cast("double") if whole_ms else F.col(value).cast("double")
    kept = newest(samples.filter(F.col(value).isNotNull()), order, n, by)
    # At most n values per group get here, so gathering them into an array is bounded.
    gathered = (
        kept.groupBy(*by)
        .agg(F.sort_array(F.collect_list(sample)).alias("_values"))
        .withColumn("_count", F.size("_values"))
        .filter(F.col("_count") > 0)
    )

    def at(p: float) -> Column:
        position = rank_position(p / 100, F.col("_count"))
        lower = F.get("_values", F.floor(position).cast("int"))
        upper = F.get("_values", F.ceil(position).cast("int"))
        return interpolate(position, lower, upper, F.col("_count"))

    return gathered.select(*by, *[at(p).alias(name) for name, p in percentiles.items()])


def value_bucket(value: Column) -> Column:
    """Coarse order-preserving bucket of a double: about a thousand per power of two."""
    size = F.abs(value)
    # Clamped so that the step never underflows to zero.
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-1000))
    step = F.pow(F.lit(2.0), exponent - 10)
    # The exponent dominates: the mantissa part stays below 4096.
    bucket = (exponent + 1100) * 4096 + F.floor(size / step)
    infinite = F.lit(float("inf"))
    return (
        F.when(F.isnan(value), F.lit(2**62 + 1))
        .when(value == infinite, F.lit(2**62))
        .when(value == -infinite, F.lit(-(2**62)))
        .when(value > 0, bucket)
        .when(value < 0, -bucket)
        .otherwise(F.lit(0))
    )


# Bits of the mantissa that each level after the first tells apart; with the ten of the
# first level these are all of a double's, so at last a bucket is a single value.
LEVEL_BITS = 14
LEVELS = 3


def bucket_path(value: Column) -> list[Column]:
    """Buckets of a double from coarse to exact; in order of the path, values are in order."""
    size = F.abs(value)
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-1000))
    scaled = size / F.pow(F.lit(2.0), exponent - 10)
    ordinary = (size > 0) & (size < float("inf"))
    path = [value_bucket(value)]
    for _ in range(LEVELS):
        # What is left of a division by a power of two is exact.
        scaled = (scaled - F.floor(scaled)) * float(1 << LEVEL_BITS)
        inner = F.floor(scaled)
        path.append(F.when(ordinary, F.when(value < 0, -inner).otherwise(inner)).otherwise(0))
    return path


#: Values a quantile sketch keeps at its lowest level, and the share of the ranks that is opened to either side of a wanted
#: one: about three times the error that the sketch keeps to with 99 % certainty.
SKETCH_SIZE, SKETCH_ERROR, SMALL_GROUP = 800, 0.01, 1000
#: Distinct values in the opened brackets of one group up to which a task puts them in order.
ORDERED_VALUES = 200_000


def exact_percentiles(
    rows: DataFrame, value: str, percentiles: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles of groups of any size, out of two scans of the rows.

    The first scan makes a mergeable quantile sketch of each group, which brackets every wanted rank. The second counts
    rows by value inside the brackets and as a whole between them, combined on the map side. The counts are stored; the
    wanted ranks are looked up in them, so that the result is exact if each lies in a bracket, which is checked. A group
    with more distinct values in its brackets than a task should order, or a rank outside of its bracket, goes
    through :func:`percentiles_by_buckets`: over the stored counts, or over the rows themselves.

    Infinite values and NaN, which is the largest, are values like others. The scans run when this is called.
    """
    keys = list(by)
    source = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    cells = _stored(_bracketed(source, keys, percentiles), "cells")
    if cells.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > ORDERED_VALUES).isEmpty():
        ranked = _opened(cells, keys, [], "_value", _positions(percentiles))
    else:
        ranked = _opened_by_buckets(cells, keys, percentiles)
    ranked = _stored(ranked, "ranked")
    if not ranked.filter("_between").isEmpty():
        return percentiles_by_buckets(source, "_value", percentiles, by)
    return _picked(ranked, keys, percentiles)


def _bracketed(source: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float]) -> DataFrame:
    """_value and _size of the values inside of brackets, and one row (_between) for what lies between two of them."""
    infinite = F.lit(float("inf"))
    finite = ~F.isnan("_value") & (F.abs("_value") != infinite)
    sketch = F.kll_sketch_agg_double(F.when(finite, F.col("_value")), SKETCH_SIZE)
    sketches = source.groupBy(*keys).agg(
        sketch.alias("_sketch"), F.count("*").alias("_total"), F.count_if(finite).alias("_finite")
    )
    # A small group is counted whole: there one rank is more than the share that is opened. A sketch of nothing cannot be asked.
    bounds = {}
    for i, p in enumerate(percentiles.values()):
        for name, share, outer in ((f"_lo{i}", p / 100 - SKETCH_ERROR, -infinite), (f"_hi{i}", p / 100 + SKETCH_ERROR, infinite)):
            if 0 < share < 1:
                asked = F.kll_sketch_get_quantile_double("_sketch", F.lit(share))
                outer = F.when(F.col("_total") <= SMALL_GROUP, outer).when(F.col("_finite") == 0, outer).otherwise(asked)
            bounds[name] = outer
    brackets = _stored(sketches.select(*keys, *[c.alias(name) for name, c in bounds.items()]), "brackets")
    inside, passed = ~finite, F.lit(0)
    for i in range(len(percentiles)):
        inside = inside | F.col("_value").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        passed = passed + (F.col("_value") > F.col(f"_hi{i}")).cast("int")
    held = brackets.select(*[F.col(k).alias(f"_in_{k}") for k in keys], *bounds)
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_in_{key}"))
    counted = source.join(held, same).select(
        *keys, "_value", (~inside).alias("_between"), F.when(inside, F.col("_value")).alias("_one"), F.when(~inside, passed).alias("_gap")
    )
    return counted.groupBy(*keys, "_between", "_one", "_gap").agg(
        F.max("_value").alias("_value"), F.count("*").alias("_size")
    ).select(*keys, "_value", "_size", "_between")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = f"{new_run_dir(rows.sparkSession, 'percentiles')}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _positions(percentiles: Mapping[str, float]) -> list[Column]:
    return [rank_position(p / 100, F.col("_total")) for p in percentiles.values()]


def percentiles_by_buckets(
    rows: DataFrame, value: str, percentiles: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """The same without a sketch.

    No values are gathered or put in order.  Each pass counts rows by bucket, combined on
    the map side, and opens the buckets that hold a wanted rank; the next pass counts
    finer buckets within these.  After the last a bucket is one value.  A task orders at
    most the buckets of one opened bucket, some thousands, whatever the values are.  The
    opened buckets, two per percentile and group, are stored between the passes, which run
    when this is called; how they meet the rows is left to their size.
    """
    keys = list(by)
    one = {"_value": F.col(value).cast("double"), "_size": F.lit(1).cast("long"), "_between": F.lit(False)}
    source = rows.filter(F.col(value).isNotNull()).select(*keys, *[c.alias(name) for name, c in one.items()])
    return _picked(_opened_by_buckets(source, keys, percentiles), keys, percentiles)


def _opened_by_buckets(source: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float]) -> DataFrame:
    levels = bucket_path(F.col("_value"))
    path = [f"_b{i}" for i in range(len(levels))]
    opened = None
    for depth, column in enumerate(path):
        upper, bounds = path[:depth], ["_start", "_total"] if depth else []
        counted = source.withColumns(dict(zip(path[: depth + 1], levels, strict=False)))
        if depth:
            counted = _inside(counted, opened, [*keys, *upper])
        sizes = counted.groupBy(*keys, *path[: depth + 1], *bounds).agg(
            F.sum("_size").alias("_size"), F.max("_value").alias("_value"), F.max("_between").alias("_between")
        )
        opened = _stored(_opened(sizes, keys, upper, column, _positions(percentiles)), column)
    return opened


def _picked(opened: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float]) -> DataFrame:
    """The percentiles out of the rows (_value, _start, _size, _total) that hold their ranks."""

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_size")), F.col("_value")))

    positions = dict(zip(percentiles, _positions(percentiles), strict=True))
    picked = {}
    for name, position in positions.items():
        picked[f"_{name}_lo"] = value_at(F.floor(position))
        picked[f"_{name}_hi"] = value_at(F.ceil(position))
    folded = opened.groupBy(*keys).agg(
        F.first("_total").alias("_total"), *[column.alias(name) for name, column in picked.items()]
    )
    return folded.filter(F.col("_total").isNotNull()).select(
        *keys,
        *[
            interpolate(position, F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col("_total")).alias(name)
            for name, position in positions.items()
        ],
    )


def _opened(
    sizes: DataFrame, keys: Sequence[str], upper: Sequence[str], column: str, positions: Sequence[Column]
) -> DataFrame:
    """Buckets holding a wanted rank, with the rank they start at and the group's size."""
    whole = Window.partitionBy(*keys, *upper)
    upwards = whole.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_size").over(upwards) - F.col("_size")
    if not upper:
        sizes = sizes.withColumns({"_start": F.lit(0).cast("long"), "_total": F.sum("_size").over(whole)})
    buckets = sizes.withColumn("_start", F.col("_start") + before)
    wanted = F.lit(False)
    for position in positions:
        for rank in (F.floor(position), F.ceil(position)):
            wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_size")))
    return buckets.filter(wanted)


def _inside(rows: DataFrame, opened: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows in opened buckets; a NULL key is a group like any other."""
    held = opened.select(*[F.col(k).alias(f"_in_{k}") for k in on], "_start", "_total")
    same = F.lit(True)
    for key in on:
        same = same & F.col(key).eqNullSafe(F.col(f"_in_{key}"))
    return rows.join(held, same).drop(*[f"_in_{k}" for k in on])
