"""The newest N rows, overall or per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import LATENCY_WINDOW

# Equal steps that a span of the order is cut into when the cut-off is looked for.
STEPS = 4096


def newest(rows: DataFrame, order: Sequence[str], n: int = LATENCY_WINDOW, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the ``n`` largest values of ``order`` (per ``by`` group, if given).

    A plain ``orderBy().limit(n)`` sends n rows of every input split to one task, and a
    plain window sends a whole hot key to one task.  Without keys, counting over the first
    column of ``order`` finds a cut-off that leaves n rows and hardly more; it is a literal
    filter, so it reaches the scan.  With keys, the rows of a key are trimmed within their
    input partition first.  ``order`` must be unique for the choice to be deterministic.
    """
    latest_first = [F.desc(c) for c in order]
    if not by:
        return _since_cut_off(rows, order[0], n).orderBy(*latest_first).limit(n)
    trimmed = _top(rows.withColumn("_slot", F.spark_partition_id()), [*by, "_slot"], latest_first, n)
    return _top(trimmed.drop("_slot"), list(by), latest_first, n)


def _since_cut_off(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Rows from the latest value on that leaves at least ``n`` of them, all rows, nulls too, if there are fewer.

    Each round counts the steps of a span, combined on the map side, and goes on with the
    step in which the n-th row lies; it ends when a step brings few rows or is one value.
    """
    kind = rows.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        number, literal = F.unix_micros(F.col(column).cast("timestamp")), lambda v: F.timestamp_micros(F.lit(v)).cast(kind)
    elif kind in ("long", "integer", "short", "byte"):
        number, literal = F.col(column).cast("long"), lambda v: F.lit(v)
    else:
        return rows
    low, high, dated = rows.agg(F.min(number), F.max(number), F.count(number)).first()
    if low is None or dated < n:
        return rows
    after = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // STEPS))
        step = F.floor((number - low) / width).cast("int")
        inside = rows.filter((F.col(column) >= literal(low)) & (F.col(column) <= literal(high)))
        sizes = {r["s"]: r["n"] for r in inside.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
        for s in sorted(sizes, reverse=True):
            if after + sizes[s] >= n:
                break
            after += sizes[s]
        else:
            break
        low, high = low + s * width, min(high, low + (s + 1) * width - 1)
        if sizes[s] <= n or width == 1:
            break
    return rows.filter(F.col(column) >= literal(low))


def _top(rows: DataFrame, keys: Sequence[str], latest_first: Sequence[Column], n: int) -> DataFrame:
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest_first)))
    return numbered.filter(F.col("_rank") <= n).drop("_rank")
