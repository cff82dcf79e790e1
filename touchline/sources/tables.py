"""Batch readers and writers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ledger import oldest_first
from touchline.schema import LEDGER, MATCH_EVENTS, ROSTER


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, as text: a JSON reader would infer types and lose the original."""
    return spark.read.text(path)


def read_raw_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)


def read_match_events(
    spark: SparkSession, path: str, first_date: str | None = None, last_date: str | None = None
) -> DataFrame:
    """The match_events table; a date range limits the partitions read."""
    table = spark.read.schema(MATCH_EVENTS).parquet(path).select(*MATCH_EVENTS.fieldNames())
    if first_date is not None:
        table = table.filter(F.col("event_date") >= F.to_date(F.lit(first_date)))
    if last_date is not None:
        table = table.filter(F.col("event_date") <= F.to_date(F.lit(last_date)))
    return table


def write_clustered(rows: DataFrame, path: str) -> None:
    """Write storage rows by date with each match kept together.

    Used to turn the many small files of a stream into large ones.  The range shuffle
    splits a hot date, and a hot match within it by time, over several tasks; sorted files
    give Parquet row groups narrow match ranges, so a single-match read skips the others.
    """
    (
        rows.repartitionByRange("event_date", "match_id", "timestamp")
        .sortWithinPartitions("event_date", "match_id", "timestamp")
        .write.mode("errorifexists")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_roster(spark: SparkSession, path: str, team_id: int) -> DataFrame:
    """A team's players from CSV with a header; identifiers stay text, positions are lower-cased."""
    players = spark.read.option("header", True).schema(ROSTER).csv(path)
    return players.select(
        F.lit(team_id).alias("team_id"), "id", "name", F.lower("position").alias("position")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The failed-event ledger, oldest entry first."""
    return oldest_first(spark.read.schema(LEDGER).parquet(path))
