"""Per-match counts and the metrics row."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import match_counts as M
from touchline.operators.percentiles import latency_percentiles
from touchline.plans import match_metrics as P

T0 = dt.datetime(2024, 1, 15, 14, 30)


def events(spark, rows):
    """Rows of (match, type, seconds after T0)."""
    data = [(m, t, T0 + dt.timedelta(seconds=s)) for m, t, s in rows]
    df = spark.createDataFrame(data, "match_id string, event_type string, ts timestamp_ntz")
    return df.select("match_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"))


def at(column):
    return F.col(column).cast("timestamp_ntz")


def metrics_row(df):
    return df.withColumns(
        {
            "first": at("first_event_at"),
            "last": at("last_event_at"),
            "peak": at("peak_minute.minute"),
            "peak_count": F.col("peak_minute.event_count"),
        }
    ).first()


def test_peak_adds_up_types(spark):
    rows = [("m", "goal", 1)] * 2 + [("m", "shot", 5)] * 8 + [("m", "shot", 65)] * 3
    row = M.peak_minute(events(spark, rows)).select(at("minute"), "event_count").first()
    assert tuple(row) == (T0, 10)


def test_earliest_minute_wins_a_tie(spark):
    rows = [("m", "pass", 125), ("m", "pass", 130), ("m", "shot", 65), ("m", "goal", 70), ("m", "pass", 0)]
    row = M.peak_minute(events(spark, rows)).select(at("minute"), "event_count").first()
    assert tuple(row) == (T0 + dt.timedelta(minutes=1), 2)


def test_peak_before_1970(spark):
    df = spark.sql("select 'm' match_id, 'pass' event_type, explode(array(timestamp'1969-12-31 23:58:30', timestamp'1969-12-31 23:59:30')) timestamp")
    assert M.peak_minute(df).select(at("minute")).first()[0] == dt.datetime(1969, 12, 31, 23, 58)


def test_summary_counts(spark):
    rows = [("m", "goal", 3)] * 2 + [("m", "yellow_card", 4)] * 3 + [("m", "pass", 9)] * 70 + [("other", "red_card", 1)]
    row = metrics_row(P.match_metrics(events(spark, rows), "m"))
    assert (row["total_events"], row["goals"], row["yellow_cards"], row["red_cards"]) == (75, 2, 3, 0)
    assert row["events_by_type"] == {"goal": 2, "pass": 70, "yellow_card": 3}
    assert (row["first"], row["last"]) == (T0 + dt.timedelta(seconds=3), T0 + dt.timedelta(seconds=9))
    assert (row["peak"], row["peak_count"]) == (T0, 75)


def test_unknown_match_has_no_row(spark):
    df = events(spark, [("m", "pass", 1)])
    for operator in (M.match_summary, M.events_by_type, M.events_per_minute, M.peak_minute, P.match_metrics):
        assert operator(df, match_id="absent").count() == 0


def test_empty_match_id_is_refused(spark):
    df = events(spark, [("m", "pass", 1)])
    for operator in (M.match_summary, M.events_per_minute, P.match_metrics):
        with pytest.raises(ValueError, match="matchID cannot be empty"):
            operator(df, match_id="")


def test_types_outside_the_list_are_counted(spark):
    df = events(spark, [("m", "throw_in", 1), ("m", "pass", 2), ("m", "throw_in", 61)])
    row = P.match_metrics(df).first()
    assert row["total_events"] == 3
    assert row["events_by_type"] == {"pass": 1, "throw_in": 2}


def test_orders_of_single_match_queries(spark):
    df = events(spark, [("m", "shot", 61), ("m", "pass", 1), ("m", "goal", 2), ("m", "shot", 3)])
    assert [tuple(r)[1:] for r in M.events_by_type(df, "m").collect()] == [("shot", 2), ("goal", 1), ("pass", 1)]
    found = [tuple(r) for r in M.events_per_minute(df, "m").select(at("minute"), "event_type", "event_count").collect()]
    later = T0 + dt.timedelta(minutes=1)
    assert found == [(T0, "goal", 1), (T0, "pass", 1), (T0, "shot", 1), (later, "shot", 1)]


def random_events(spark, n=3000):
    rng = random.Random(5)
    # One match holds a third of all rows.
    return events(
        spark,
        [
            (
                "hot" if rng.random() < 0.34 else f"m{rng.randrange(40)}",
                rng.choice(["pass", "shot", "goal", "foul", "odd"]),
                rng.randrange(0, 7200),
            )
            for _ in range(n)
        ],
    )


def as_set(df):
    return {json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect()}


def test_metrics_row_agrees_with_its_parts(spark):
    df = random_events(spark)
    metrics = P.match_metrics(df)
    parts = (
        M.match_summary(df)
        .join(M.events_by_type_map(df), "match_id")
        .join(M.peak_minute(df).select("match_id", F.struct("minute", "event_count").alias("peak_minute")), "match_id")
    )
    assert as_set(metrics.select(*sorted(metrics.columns))) == as_set(parts.select(*sorted(metrics.columns)))


def test_rollup_gives_the_same_metrics(spark):
    df = random_events(spark)
    halves = [df.filter(F.second("timestamp") % 2 == i) for i in (0, 1)]
    cells = P.merge_cells(P.minute_cells(halves[0]).unionByName(P.minute_cells(halves[1])))
    assert as_set(P.match_metrics_from_cells(cells)) == as_set(P.match_metrics(df))
    assert as_set(P.match_metrics_from_cells(cells, "hot")) == as_set(P.match_metrics(df, "hot"))


def test_activity(spark):
    rows = [("m", "pass", s) for s in (0, 1, 61, 62, 63, 190)]
    row = M.match_activity(events(spark, rows)).first()
    assert (row["total_events"], row["events_per_minute"], row["average_per_minute"]) == (6, [2, 3, 1], 2.0)
    assert M.match_activity(events(spark, rows), minutes=90).first()["average_per_minute"] == 6 / 90


def test_metrics_document(spark):
    df = events(spark, [("m", "goal", 1), ("m", "pass", 61)])
    samples = spark.createDataFrame([(1, T0, 50.0)], "seq bigint, ts timestamp_ntz, duration_ms double")
    metrics = P.match_metrics(df)
    body = json.loads(P.metrics_json(P.with_latency(metrics, latency_percentiles(samples))).first()["body"])
    assert body == {
        "matchId": "m",
        "totalEvents": 2,
        "eventsByType": {"goal": 1, "pass": 1},
        "goals": 1,
        "yellowCards": 0,
        "redCards": 0,
        "firstEventAt": "2024-01-15T14:30:01Z",
        "lastEventAt": "2024-01-15T14:31:01Z",
        "peakMinute": {"minute": "2024-01-15T14:30:00Z", "eventCount": 1},
        "responseTimePercentiles": {"p50": 50.0, "p95": 50.0, "p99": 50.0},
    }
    nothing = latency_percentiles(samples.filter("seq < 0"))
    body = json.loads(P.metrics_json(P.with_latency(metrics, nothing)).first()["body"])
    assert "responseTimePercentiles" not in body and body["totalEvents"] == 2


def test_events_without_a_type_count_in_the_total_only(spark):
    rows = [("m", None, "2031-05-04 18:07:09"), ("m", "goal", "2031-05-04 18:07:10"), ("n", None, "2031-05-04 18:07:09")]
    df = spark.createDataFrame(rows, "match_id string, event_type string, ts string").selectExpr(
        "match_id", "event_type", "cast(ts as timestamp) as timestamp"
    )
    found = {r["match_id"]: (r["total_events"], r["events_by_type"]) for r in P.match_metrics(df).collect()}
    assert found == {"m": (2, {"goal": 1}), "n": (1, {})}
    assert {r["match_id"]: r["events_by_type"] for r in M.events_by_type_map(df).collect()} == {"m": {"goal": 1}, "n": {}}
