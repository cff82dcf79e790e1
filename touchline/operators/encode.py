"""Outgoing row shapes: storage rows, topic rows, receipts, retry and dead-letter rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.documents import object_json
from touchline.functions.times import format_rfc3339
from touchline.schema import DEAD_LETTER_REASON


def present(events: DataFrame) -> DataFrame:
    """Leave out null events."""
    return events.filter(F.col("event_id").isNotNull())


def storage_rows(events: DataFrame) -> DataFrame:
    """VALID_EVENT rows in the column order and types of the match_events table."""
    return present(events).select(
        "event_id",
        "match_id",
        "event_type",
        F.col("team_id").cast("string").alias("team_id"),
        F.nullif(F.col("player_id"), F.lit("")).alias("player_id"),
        object_json(F.col("metadata")).alias("metadata"),
        "timestamp",
        F.to_date("timestamp").alias("event_date"),
    )


def _envelope_struct() -> Column:
    has_metadata = object_json(F.col("metadata")) != "{}"
    return F.struct(
        F.col("event_id").alias("eventId"),
        F.col("match_id").alias("matchId"),
        F.col("event_type").alias("eventType"),
        format_rfc3339(F.col("timestamp")).alias("timestamp"),
        F.col("team_id").alias("teamId"),
        F.coalesce("player_id", F.lit("")).alias("playerId"),
        # A NULL field is left out of the JSON, as an absent or empty object must be.
        F.when(has_metadata, F.col("metadata")).alias("metadata"),
    )


def envelope_json() -> Column:
    """Envelope text of a VALID_EVENT row."""
    return F.to_json(_envelope_struct())


def header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))


def _common_headers() -> list[Column]:
    return [header("event_type", F.col("event_type")), header("event_id", F.col("event_id"))]


def publish_rows(events: DataFrame, topic: str = "events", null_event_fails: bool = False) -> DataFrame:
    """Topic rows keyed by match, so that one match stays in order in one partition.

    Null events are left out, or fail the job with ``null_event_fails``.
    """
    key = F.col("match_id").cast("binary")
    if null_event_fails:
        key = F.when(F.col("event_id").isNull(), F.raise_error(F.lit("event cannot be nil"))).otherwise(key)
    return (events if null_event_fails else present(events)).select(
        key.alias("key"),
        envelope_json().cast("binary").alias("value"),
        F.array(*_common_headers()).alias("headers"),
        F.lit(topic).alias("topic"),
        "timestamp",
    )


def in_match_order(events: DataFrame) -> DataFrame:
    """Rows of a match next to each other in time order, for sinks that keep arrival order.

    Range partitioning splits a hot match by time instead of giving it to one task; the
    order then runs on from one partition to the next.
    """
    return events.repartitionByRange("match_id", "timestamp").sortWithinPartitions("match_id", "timestamp")


def retry_rows(routed: DataFrame, topic: str = "retry") -> DataFrame:
    """Topic rows for another attempt; ``retry_count`` travels as one byte."""
    attempt = F.unhex(F.lpad(F.hex(F.col("retry_count") % 256), 2, "0"))
    stamp = format_rfc3339(F.col("timestamp"))
    return routed.select(
        F.col("match_id").cast("binary").alias("key"),
        envelope_json().cast("binary").alias("value"),
        F.array(
            *_common_headers(), header("retry_count", attempt), header("original_timestamp", stamp)
        ).alias("headers"),
        F.lit(topic).alias("topic"),
    )


def dead_letter_rows(routed: DataFrame, failed_at: Column | None = None, topic: str = "dead") -> DataFrame:
    """Topic rows for events given up on: the envelope plus when and why it failed."""
    stamp = format_rfc3339(F.current_timestamp() if failed_at is None else failed_at)
    body = F.to_json(
        F.struct(
            _envelope_struct().alias("event"),
            "event_id",
            "event_type",
            stamp.alias("failed_at"),
            "match_id",
            F.lit(DEAD_LETTER_REASON).alias("reason"),
        )
    )
    return routed.select(
        F.col("match_id").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.array(*_common_headers(), header("failed_at", stamp)).alias("headers"),
        F.lit(topic).alias("topic"),
    )


def receipts(events: DataFrame, now: Column | None = None) -> DataFrame:
    """One acceptance receipt per published event."""
    stamp = F.current_timestamp() if now is None else now
    return present(events).select("event_id", F.lit("accepted").alias("status"), stamp.alias("timestamp"))
