"""Where the rows of a failed batch go: another attempt, the dead-letter topic, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.schema import MAX_RETRIES

RETRY, DEAD, LOST = "retry", "dead", "lost"


def header_value(headers: Column, name: str) -> Column:
    """Last non-empty value under a header name, NULL when there is none."""
    matching = F.filter(headers, lambda h: (h["key"] == name) & (F.length(h["value"]) > 0))
    return F.try_element_at(matching, F.lit(-1))["value"]


def attempts_so_far(headers: Column) -> Column:
    """Retry count carried by a topic row, 0 when absent."""
    first_byte = F.substring(header_value(headers, "retry_count"), 1, 1)
    return F.coalesce(F.conv(F.hex(first_byte), 16, 10).cast("int"), F.lit(0))


def route_failed(
    events: DataFrame, max_retries: int = MAX_RETRIES, retry_available: bool = True, dead_available: bool = True
) -> DataFrame:
    """Add ``retry_count`` (this failure counted) and ``route`` to the rows of a failed batch.

    Each row gets exactly one route.  Without a retry topic everything is dead-lettered;
    without a dead-letter topic those rows are lost, and stay countable as such.
    """
    give_up = DEAD if dead_available else LOST
    counted = events.withColumn("retry_count", attempts_so_far(F.col("headers")) + 1)
    again = (F.col("retry_count") <= max_retries) if retry_available else F.lit(False)
    return counted.withColumn("route", F.when(again, F.lit(RETRY)).otherwise(F.lit(give_up)))


def replay_rows(retry_topic: DataFrame, topic: str = "events") -> DataFrame:
    """Retry rows put back on the event topic with their headers, so the count advances."""
    return retry_topic.select("key", "value", "headers", F.lit(topic).alias("topic"))


def batch_audit(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Rows per outcome (and per ``keys``, such as the batch)."""
    return outcomes.groupBy(*keys, "outcome").agg(F.count("*").alias("rows"))


def consumer_lag(topic: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows not yet consumed per topic and partition.

    ``committed`` holds (topic, partition, committed_offset), the offset of the next row
    to read; a partition never committed counts from its start.
    """
    ends = topic.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset")
    )
    start = F.coalesce("committed_offset", "first_offset")
    return ends.join(committed, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        "next_offset",
        start.alias("committed_offset"),
        (F.col("next_offset") - start).alias("lag"),
    )
