"""The ledger of events that could not be delivered, and its retry runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import DEFAULT_FAILURE_REASON, MAX_RETRIES, SUCCESS_CODES
from touchline.session import new_run_dir

RESENT, FAILED, SKIPPED = "resent", "failed", "skipped"


def oldest_first(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("created_at", "id")


def with_place(ledger: DataFrame) -> DataFrame:
    """The entries with their place, from 1, when the oldest comes first.

    Ranges of entries are numbered side by side; only the sizes of the ranges meet in one task. The ranges are stored
    first, because dealing them out again might draw other bounds.
    """
    path = f"{new_run_dir(ledger.sparkSession, 'places')}/ranges"
    ranges = ledger.repartitionByRange("created_at", "id").withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = ledger.sparkSession.read.schema(ranges.schema).parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("created_at", "id"))
    return ranges.join(starts, "_range").withColumn("place", F.col("_start") + inside).drop("_range", "_start")


def eligible(ledger: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Entries that may still be tried."""
    return ledger.filter(F.col("retry_count") < max_retries)


def new_entries(
    failures: DataFrame, event_data: Column, reason: Column | None = None, first_id: int = 1, now: Column | None = None
) -> DataFrame:
    """Ledger rows for fresh failures.

    Identifiers are unique and above ``first_id - 1`` but not consecutive: numbering them
    without gaps would need all rows in one task.
    """
    told = F.lit(None).cast("string") if reason is None else reason
    return failures.select(
        (F.monotonically_increasing_id() + first_id).alias("id"),
        event_data.alias("event_data"),
        F.coalesce(told, F.lit(DEFAULT_FAILURE_REASON)).alias("failure_reason"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
        F.lit(0).alias("retry_count"),
    )


def next_id(ledger: DataFrame) -> int:
    """Smallest identifier above every one in use."""
    return (ledger.agg(F.max("id")).first()[0] or 0) + 1


def retry_run(
    ledger: DataFrame,
    outcomes: DataFrame,
    max_retries: int = MAX_RETRIES,
    success_codes: Sequence[int] = SUCCESS_CODES,
) -> DataFrame:
    """Each ledger entry with its ``result`` of one retry run.

    ``outcomes`` holds (id, status_code); no row or a NULL code means no answer.  Several
    answers for one entry count as one, successful if any was.
    """
    answers = outcomes.groupBy("id").agg(F.max(F.col("status_code").isin(*success_codes)).alias("_ok"))
    result = (
        F.when(F.col("retry_count") >= max_retries, SKIPPED)
        .when(F.coalesce("_ok", F.lit(False)), RESENT)
        .otherwise(FAILED)
    )
    return ledger.join(answers, "id", "left").withColumn("result", result).drop("_ok")


def ledger_after(run: DataFrame) -> DataFrame:
    """The ledger once a run is applied: resent entries gone, failed ones counted up."""
    bumped = F.when(F.col("result") == FAILED, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    return run.filter(F.col("result") != RESENT).withColumn("retry_count", bumped).drop("result")


def run_summary(run: DataFrame) -> DataFrame:
    """Entries tried successfully, still failed (skipped ones included), and left in the ledger."""
    resent = F.count_if(F.col("result") == RESENT)
    return run.agg(
        F.count("*").alias("found"),
        resent.alias("resent"),
        (F.count("*") - resent).alias("still_failed"),
        (F.count("*") - resent).alias("remaining"),
    )


def delivery_counts(attempts: DataFrame, *keys: str, success_codes: Sequence[int] = SUCCESS_CODES) -> DataFrame:
    """Events sent and failed, from a table of delivery attempts with a ``status_code``."""
    sent = F.count_if(F.col("status_code").isin(*success_codes))
    return attempts.groupBy(*keys).agg(sent.alias("sent"), (F.count("*") - sent).alias("failed"))
