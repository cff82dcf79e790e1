"""The full metrics row of every match from one scan, and the minute roll-up that can replace the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.times import format_rfc3339, minute_of
from touchline.operators.match_counts import earliest_peak_key, for_match


def minute_cells(events: DataFrame, minute: Column | None = None) -> DataFrame:
    """Roll-up of match_events by match, minute and type; cells of two batches may be added up."""
    start = minute_of(F.col("timestamp")) if minute is None else minute
    return events.groupBy("match_id", start.alias("minute"), "event_type").agg(
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("first_event_at"),
        F.max("timestamp").alias("last_event_at"),
    )


def match_metrics(events: DataFrame, match_id: str | None = None) -> DataFrame:
    """One metrics row per match, read from match_events."""
    rows = for_match(events, match_id).select(
        "match_id", "event_type", minute_of(F.col("timestamp")).alias("minute"), "timestamp"
    )
    return _metrics(rows, F.count("*"), F.min("timestamp"), F.max("timestamp"))


def merge_cells(cells: DataFrame) -> DataFrame:
    """One cell per match, minute and type out of the roll-ups of several batches."""
    return cells.groupBy("match_id", "minute", "event_type").agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
    )


def match_metrics_from_cells(cells: DataFrame, match_id: str | None = None) -> DataFrame:
    """The same row read from a minute roll-up."""
    rows = for_match(cells, match_id)
    return _metrics(rows, F.sum("event_count"), F.min("first_event_at"), F.max("last_event_at"))


def _metrics(rows: DataFrame, count: Column, first: Column, last: Column) -> DataFrame:
    """Count by (match, minute) and by (match, type) in one pass, then fold per match.

    Both groupings come out of one grouping-sets aggregation, so the table is scanned once
    and nothing is joined; rows are combined on the map side before either shuffle, and a
    hot match reaches the second one as its minutes and types only.  Types outside the
    known list are counted like any other.
    """
    grouped = rows.groupingSets(
        [["match_id", "minute"], ["match_id", "event_type"]], "match_id", "minute", "event_type"
    ).agg(
        (F.grouping("event_type") == 1).alias("by_minute"),
        count.alias("event_count"),
        first.alias("first_event_at"),
        last.alias("last_event_at"),
    )
    by_minute, n = F.col("by_minute"), F.col("event_count")

    def typed(name: str) -> Column:
        return F.coalesce(F.sum(F.when(~by_minute & (F.col("event_type") == name), n)), F.lit(0))

    minute_key = F.when(by_minute, earliest_peak_key(F.col("minute"), n))
    # Events without a type count in the total but have no entry: a map has no NULL key.
    type_entry = F.when(~by_minute & F.col("event_type").isNotNull(), F.struct("event_type", "event_count"))
    return grouped.groupBy("match_id").agg(
        F.sum(F.when(by_minute, n)).alias("total_events"),
        F.map_from_entries(F.sort_array(F.collect_list(type_entry))).alias("events_by_type"),
        typed("goal").alias("goals"),
        typed("yellow_card").alias("yellow_cards"),
        typed("red_card").alias("red_cards"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.struct(
            F.max_by("minute", minute_key).alias("minute"),
            F.max(F.when(by_minute, n)).alias("event_count"),
        ).alias("peak_minute"),
    )


def with_latency(metrics: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Attach the latency percentiles (one row of p50, p95, p99, or none) to every match."""
    one = percentiles.agg(F.first(F.struct("p50", "p95", "p99")))
    return metrics.withColumn("response_time_percentiles", one.scalar())


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(match_id, body): the metrics document of each match; absent parts are left out."""
    fields = [
        F.col("match_id").alias("matchId"),
        F.col("total_events").alias("totalEvents"),
        F.col("events_by_type").alias("eventsByType"),
        F.col("goals"),
        F.col("yellow_cards").alias("yellowCards"),
        F.col("red_cards").alias("redCards"),
        format_rfc3339(F.col("first_event_at")).alias("firstEventAt"),
        format_rfc3339(F.col("last_event_at")).alias("lastEventAt"),
        F.struct(
            format_rfc3339(F.col("peak_minute.minute")).alias("minute"),
            F.col("peak_minute.event_count").alias("eventCount"),
        ).alias("peakMinute"),
    ]
    if "response_time_percentiles" in metrics.columns:
        fields.append(F.col("response_time_percentiles").alias("responseTimePercentiles"))
    return metrics.select("match_id", F.to_json(F.struct(*fields)).alias("body"))
