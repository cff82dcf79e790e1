"""Per-match counts over match_events; every operator works for all matches or for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.times import minute_of


def for_match(events: DataFrame, match_id: str | None) -> DataFrame:
    """Rows of one match, or all rows for None; the filter reaches the Parquet scan."""
    if match_id is None:
        return events
    if match_id == "":
        raise ValueError("matchID cannot be empty")
    return events.filter(F.col("match_id") == F.lit(match_id))


def match_summary(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """Totals, goal and card counts, first and last event.  No row for an unknown match."""
    event_type = F.col("event_type")
    return (
        for_match(events, match_id)
        .groupBy("match_id")
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(event_type == "goal").alias("goals"),
            F.count_if(event_type == "yellow_card").alias("yellow_cards"),
            F.count_if(event_type == "red_card").alias("red_cards"),
            F.min("timestamp").alias("first_event_at"),
            F.max("timestamp").alias("last_event_at"),
        )
    )


def events_by_type(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """Rows per match and event type; one match comes back largest count first."""
    counts = for_match(events, match_id).groupBy("match_id", "event_type").agg(F.count("*").alias("event_count"))
    return counts if match_id is None else counts.orderBy(F.desc("event_count"), "event_type")


def events_by_type_map(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """The same as a map, entries in type order.  Counted first, so only totals are gathered.

    Events without a type have no entry, as a map cannot have a NULL key.
    """
    entry = F.when(F.col("event_type").isNotNull(), F.struct("event_type", "event_count"))
    return (
        events_by_type(for_match(events, match_id))
        .groupBy("match_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("events_by_type"))
    )


def events_per_minute(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """Rows per match, minute and event type; one match comes back in minute order."""
    counts = (
        for_match(events, match_id)
        .groupBy("match_id", minute_of(F.col("timestamp")).alias("minute"), "event_type")
        .agg(F.count("*").alias("event_count"))
    )
    return counts if match_id is None else counts.orderBy("minute", "event_type")


def minute_totals(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """Rows per match and minute over all types."""
    return (
        for_match(events, match_id)
        .groupBy("match_id", minute_of(F.col("timestamp")).alias("minute"))
        .agg(F.count("*").alias("event_count"))
    )


def earliest_peak_key(minute, event_count):
    """Ordering key whose maximum is the largest count and, on a tie, the earliest minute.

    One decimal instead of a (count, minute) struct keeps ``max_by`` inside the hash
    aggregation; a struct would force a sort.  11 digits hold the seconds of any year up
    to 9999, the rest hold the count.
    """
    shifted = event_count.cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    return shifted - F.unix_seconds(minute).cast("decimal(13,0)")


def peak_minute(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """Busiest minute per match, the earliest one on a tie."""
    key = earliest_peak_key(F.col("minute"), F.col("event_count"))
    return (
        minute_totals(events, match_id)
        .groupBy("match_id")
        .agg(F.max_by("minute", key).alias("minute"), F.max("event_count").alias("event_count"))
    )


def match_activity(events: DataFrame, minutes: int | None = None, match_id: str | None = None) -> DataFrame:
    """Total, per-minute counts in minute order, and the average per minute.

    ``minutes`` is the scheduled match length; by default the minutes that had events.
    The list holds one number per minute, so its size follows the match's length.
    """
    length = F.count("*") if minutes is None else F.lit(minutes)
    return (
        minute_totals(events, match_id)
        .groupBy("match_id")
        .agg(
            F.sum("event_count").alias("total_events"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("minute", "event_count"))), lambda m: m["event_count"]
            ).alias("events_per_minute"),
            (F.sum("event_count") / length).alias("average_per_minute"),
        )
    )
