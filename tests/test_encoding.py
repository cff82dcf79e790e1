"""Storage rows, envelopes, topic rows and the rules for failed batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators.decode import decode_envelopes
from touchline.operators.encode import (
    dead_letter_rows,
    envelope_json,
    header,
    in_match_order,
    publish_rows,
    receipts,
    retry_rows,
    storage_rows,
)
from touchline.operators.routing import attempts_so_far, consumer_lag, header_value, replay_rows, route_failed
from touchline.schema import DEAD_LETTER_REASON, MATCH_EVENTS, TOPIC_HEADERS

UUID = "7d1f0c3a-52b6-4e0d-8c4f-2a9be6d10f57"
SHAPE = "event_id string, match_id string, event_type string, ts string, team_id int, player_id string, m string"


def events(spark, *rows):
    df = spark.createDataFrame(list(rows), SHAPE)
    return df.select(
        "event_id",
        "match_id",
        "event_type",
        F.to_timestamp("ts").alias("timestamp"),
        "team_id",
        "player_id",
        F.parse_json("m").alias("metadata"),
    )


def one(spark, metadata=None, player="no-4", ts="2024-01-15T14:30:00Z"):
    return events(spark, (UUID, "match-1", "shot", ts, 2, player, metadata))


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, {}),
        ("null", {}),
        ("{}", {}),
        ('{"wind": -3.25, "keeper": "beaten", "replays": 0}', {"wind": -3.25, "keeper": "beaten", "replays": 0}),
        ('{"path": [[0, 1], [2, {}]], "ref": {"late": true, "by": null}}', {"path": [[0, 1], [2, {}]], "ref": {"late": True, "by": None}}),
    ],
)
def test_metadata_at_rest(spark, given, expected):
    text = storage_rows(one(spark, given)).first()["metadata"]
    assert json.loads(text) == expected


def test_metadata_keys_are_sorted_at_every_level(spark):
    text = storage_rows(one(spark, '{"b": {"d": 1, "c": 2}, "a": 3}')).first()["metadata"]
    assert text == '{"a":3,"b":{"c":2,"d":1}}'


def test_storage_row(spark):
    df = storage_rows(one(spark, player=""))
    assert [f.name for f in df.schema] == MATCH_EVENTS.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in MATCH_EVENTS]
    row = df.first()
    assert (row["team_id"], row["player_id"], row["event_date"]) == ("2", None, dt.date(2024, 1, 15))


def test_null_events_are_left_out(spark):
    rows = events(spark, (None, "m", "shot", "2024-01-15T14:30:00Z", 1, "", None))
    assert storage_rows(rows).count() == publish_rows(rows).count() == receipts(rows).count() == 0


def test_null_event_can_fail_the_job(spark):
    rows = events(spark, (None, "m", "shot", "2024-01-15T14:30:00Z", 1, "", None))
    with pytest.raises(Exception, match="event cannot be nil"):
        publish_rows(rows, null_event_fails=True).collect()
    assert publish_rows(one(spark), null_event_fails=True).count() == 1


def test_envelope_text(spark):
    full = one(spark, '{"on_target": true, "distance": 18.5}', ts="2024-01-15T14:30:00.120Z").select(envelope_json()).first()[0]
    assert full == (
        '{"eventId":"%s","matchId":"match-1","eventType":"shot","timestamp":"2024-01-15T14:30:00.12Z","teamId":2,'
        '"playerId":"no-4","metadata":{"distance":18.5,"on_target":true}}' % UUID
    )
    for empty in (None, "null", "{}"):
        text = one(spark, empty, player="").select(envelope_json()).first()[0]
        assert text.endswith('"teamId":2,"playerId":""}')


@pytest.mark.parametrize(
    "ts, text",
    [
        ("2024-01-15T14:30:10Z", "14:30:10Z"),
        ("2024-01-15T14:30:00.5Z", "14:30:00.5Z"),
        ("2024-01-15T14:30:00.000001Z", "14:30:00.000001Z"),
        ("2024-01-15T14:30:00.100100Z", "14:30:00.1001Z"),
    ],
)
def test_envelope_timestamp_fraction(spark, ts, text):
    assert json.loads(one(spark, ts=ts).select(envelope_json()).first()[0])["timestamp"] == "2024-01-15T" + text


def test_round_trip(spark):
    sent = events(
        spark,
        (UUID, "match-1", "shot", "2024-01-15T14:30:00.25Z", 2, "no-4", '{"blocked": false, "speed": 97.5}'),
        (UUID, "match-2", "pass", "2024-01-15T14:30:00Z", 1, "", None),
    )
    back = decode_envelopes(publish_rows(sent))
    assert not any(r["parse_error"] for r in back.collect())
    assert sorted(map(tuple, storage_rows(back).collect())) == sorted(map(tuple, storage_rows(sent).collect()))
    assert {r["player_id"] for r in back.collect()} == {"no-4", ""}


def envelope(**changes):
    doc = {
        "eventId": UUID,
        "matchId": "m",
        "eventType": "goal",
        "timestamp": "2024-01-15T14:30:00Z",
        "teamId": 1,
        "playerId": "p",
    }
    return json.dumps({**doc, **changes})


def test_envelope_checks(spark):
    cases = {
        envelope(): False,
        envelope(eventType="zzz", teamId=9, matchId=""): False,
        envelope() + "  \n": False,
        "}{": True,
        "": True,
        "null": True,
        envelope(eventId=UUID[:-2]): True,
        envelope(timestamp="noon"): True,
        envelope(teamId="1"): True,
        envelope() + " x": True,
        envelope() + envelope(): True,
        envelope() + "," + envelope(): True,
        envelope() + "] x": True,
        envelope() + "]}": True,
        envelope() + ',"x"] {}': True,
    }
    topic = spark.createDataFrame([(v,) for v in cases], "value string").withColumn("value", F.col("value").cast("binary"))
    found = {bytes(r["value"]).decode(): r["parse_error"] for r in decode_envelopes(topic).collect()}
    assert found == cases


def test_publish_row(spark):
    row = publish_rows(one(spark)).first()
    assert bytes(row["key"]) == b"match-1"
    assert [(h["key"], bytes(h["value"])) for h in row["headers"]] == [("event_type", b"shot"), ("event_id", UUID.encode())]
    assert row["timestamp"] == one(spark).first()["timestamp"]


def failed(spark, *counts):
    """Events with the given retry_count headers: None for no header, bytes for its value."""
    rows = []
    for n, count in enumerate(counts):
        headers = [] if count is None else [("retry_count", bytearray(count))]
        rows.append((n, [("event_id", bytearray(b"x")), *headers]))
    keyed = spark.createDataFrame(rows, "n int, headers array<struct<key:string,value:binary>>")
    return keyed.select(
        "n",
        "headers",
        F.lit(UUID).alias("event_id"),
        F.lit("match-1").alias("match_id"),
        F.lit("shot").alias("event_type"),
        F.to_timestamp(F.lit("2024-01-15T14:30:00Z")).alias("timestamp"),
        F.lit(2).alias("team_id"),
        F.lit("no-4").alias("player_id"),
        F.parse_json(F.lit("{}")).alias("metadata"),
    )


def test_retry_routes(spark):
    df = route_failed(failed(spark, None, b"\x01", b"\x02", b"\x03", b"", b"\xff"))
    found = [(r["retry_count"], r["route"]) for r in df.orderBy("n").collect()]
    assert found == [(1, "retry"), (2, "retry"), (3, "retry"), (4, "dead"), (1, "retry"), (256, "dead")]


def test_routes_without_outputs(spark):
    df = failed(spark, None, b"\x03")

    def routes(**kwargs):
        return [r["route"] for r in route_failed(df, **kwargs).orderBy("n").collect()]

    assert routes(retry_available=False) == ["dead", "dead"]
    assert routes(dead_available=False) == ["retry", "lost"]
    assert routes(retry_available=False, dead_available=False) == ["lost", "lost"]
    assert routes(max_retries=4) == ["retry", "retry"]


def test_last_non_empty_header_wins(spark):
    df = spark.createDataFrame(
        [([("retry_count", bytearray(b"\x01")), ("retry_count", bytearray(b"\x02")), ("retry_count", bytearray(b""))],)],
        TOPIC_HEADERS.simpleString().join(["headers ", ""]),
    )
    assert df.select(attempts_so_far(F.col("headers"))).first()[0] == 2


def test_retry_row_and_replay(spark):
    routed = route_failed(failed(spark, b"\x01"))
    rows = retry_rows(routed)
    headers = {h["key"]: bytes(h["value"]) for h in rows.first()["headers"]}
    assert headers == {
        "event_type": b"shot",
        "event_id": UUID.encode(),
        "retry_count": b"\x02",
        "original_timestamp": b"2024-01-15T14:30:00Z",
    }
    again = route_failed(decode_envelopes(replay_rows(rows))).first()
    assert (again["retry_count"], again["route"]) == (3, "retry")


def test_dead_letter_row(spark):
    row = dead_letter_rows(route_failed(failed(spark, b"\x03")), F.to_timestamp(F.lit("2024-02-01T00:00:00.5Z"))).first()
    body = json.loads(bytes(row["value"]))
    assert list(body) == ["event", "event_id", "event_type", "failed_at", "match_id", "reason"]
    assert list(body["event"]) == ["eventId", "matchId", "eventType", "timestamp", "teamId", "playerId"]
    assert (body["reason"], body["failed_at"]) == (DEAD_LETTER_REASON, "2024-02-01T00:00:00.5Z")
    assert [h["key"] for h in row["headers"]] == ["event_type", "event_id", "failed_at"]


def test_receipt(spark):
    row = receipts(one(spark)).first()
    assert (row["event_id"], row["status"]) == (UUID, "accepted") and row["timestamp"] is not None


def test_header_value(spark):
    df = spark.range(1).select(F.array(header("a", F.lit("1")), header("b", F.lit("2"))).alias("h"))
    row = df.select(header_value(F.col("h"), "b"), header_value(F.col("h"), "c")).first()
    assert (bytes(row[0]), row[1]) == (b"2", None)


def test_match_order_runs_on_over_partitions(spark):
    rows = [(UUID, f"m{i % 3}", "pass", f"2024-01-15T14:{i % 60:02d}:00Z", 1, "", None) for i in range(120)]
    ordered = in_match_order(events(spark, *rows)).select("match_id", "timestamp").collect()
    assert ordered == sorted(ordered)


def test_lag(spark):
    topic = spark.createDataFrame(
        [("t", 0, 5), ("t", 0, 9), ("t", 1, 3), ("t", 1, 4), ("t", 2, 7)], "topic string, partition int, offset bigint"
    )
    committed = spark.createDataFrame([("t", 0, 7), ("t", 2, 8)], "topic string, partition int, committed_offset bigint")
    found = {r["partition"]: r["lag"] for r in consumer_lag(topic, committed).collect()}
    assert found == {0: 3, 1: 2, 2: 0}
