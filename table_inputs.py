"""Reads the generic ``events`` and ``customer`` tables as the engine's own inputs.

``events(event_id, ts, user_id, event_type, value, props)`` stands in for match events,
topics, latency samples, request logs and ledgers; ``customer`` for the roster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.encode import envelope_json, header
from touchline.schema import TOPIC_HEADERS

# Click stream type -> match event type.
TYPE_NAMES = {"click": "pass", "view": "shot", "purchase": "goal", "error": "yellow_card", "signup": "red_card"}

ROWS_PER_BATCH = 1000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _uuid() -> Column:
    return F.format_string("00000000-0000-4000-8000-%012x", F.col("event_id"))


def _match_id() -> Column:
    return F.concat_ws("-", F.lit("match"), F.to_date("ts").cast("string"), (F.col("user_id") % 4).cast("string"))


def _match_type() -> Column:
    cases = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, match_type in TYPE_NAMES.items():
        cases = cases.when(F.col("event_type") == name, F.lit(match_type))
    return cases.otherwise(F.col("event_type"))


def _player() -> Column:
    shirt = F.col("user_id") % 23
    return F.when(shirt == 0, F.lit("")).otherwise(F.concat(F.lit("p"), shirt.cast("string")))


def valid_events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """VALID_EVENT rows; ``seq`` is the source's number and may be kept."""
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        _uuid().alias("event_id"),
        _match_id().alias("match_id"),
        _match_type().alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_id") % 2 + 1).cast("int").alias("team_id"),
        _player().alias("player_id"),
        F.parse_json("props").alias("metadata"),
        "user_id",
    )
    wanted = ("event_id", "match_id", "event_type", "timestamp", "team_id", "player_id", "metadata")
    return rows.select(*keep, *wanted)


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of match_events that counting needs."""
    return events(spark, sf_dir).select(
        _match_id().alias("match_id"), _match_type().alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp")
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, value): wire JSON, damaged in a way that follows from ``event_id % 16``."""
    kind = F.col("event_id") % 16
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    moved = F.date_format(F.col("ts") + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.to_json(
        F.struct(
            F.when(kind == 0, "not-a-uuid")
            .when(kind == 12, F.concat(F.lit("urn:uuid:"), F.upper(_uuid())))
            .otherwise(_uuid())
            .alias("eventId"),
            F.when(kind.isin(1, 10), "").otherwise(_match_id()).alias("matchId"),
            F.when(kind == 2, F.upper(_match_type())).otherwise(_match_type()).alias("eventType"),
            F.when(kind == 3, stamp)
            .when(kind == 13, F.concat(moved, F.lit("+03:00")))
            .otherwise(F.concat(stamp, F.lit("Z")))
            .alias("timestamp"),
            F.when(kind.isin(4, 10), 3).otherwise((F.col("event_id") % 2 + 1).cast("int")).alias("teamId"),
            F.when(kind != 11, _player()).alias("playerId"),
            F.when(kind != 8, F.parse_json("props")).alias("metadata"),
        )
    )
    damaged = (
        F.when(kind == 5, F.regexp_replace("body", r'"teamId":(\d)', r'"teamId":"$1"'))
        .when(kind == 6, F.regexp_replace("body", r'"matchId":"[^"]*"', '"matchId":5'))
        .when(kind == 7, F.expr("left(body, length(body) - 1)"))
        .when(kind == 9, F.concat(F.col("body"), F.lit(" trailing")))
        .otherwise(F.col("body"))
    )
    return events(spark, sf_dir).withColumn("body", body).select(
        F.col("event_id").alias("doc_id"), damaged.alias("value")
    )


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic rows of all events; four of five carry a retry count of 0 to 3."""
    rows = valid_events(spark, sf_dir, "seq", "user_id")
    count = F.col("seq") % 5
    retry = F.when(count < 4, F.array(header("retry_count", F.unhex(F.lpad(F.hex(count), 2, "0")))))
    return rows.select(
        F.col("match_id").cast("binary").alias("key"),
        envelope_json().cast("binary").alias("value"),
        F.concat(
            F.array(header("event_type", F.col("event_type")), header("event_id", F.col("event_id"))),
            F.coalesce(retry, F.array().cast(TOPIC_HEADERS)),
        ).alias("headers"),
        F.lit("events").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("seq").alias("offset"),
        "timestamp",
    )


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "ts", "event_type", F.col("value").alias("duration_ms")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingest = F.col("event_type").isin("click", "view", "purchase")
    turn = F.col("event_id") % 10
    return events(spark, sf_dir).select(
        "ts",
        F.when(ingest, "POST").otherwise("GET").alias("method"),
        F.when(ingest, F.lit("/api/events"))
        .otherwise(F.concat(F.lit("/api/matches/"), _match_id(), F.lit("/metrics")))
        .alias("path"),
        F.when(turn == 0, F.when(ingest, 400).otherwise(404))
        .when(turn == 1, F.when(ingest, 503).otherwise(500))
        .otherwise(F.when(ingest, 202).otherwise(200))
        .alias("status"),
        (F.col("value") / 1000).alias("duration_s"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type ``error`` as entries that failed 0 to 4 times."""
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("id"),
            F.col("props").alias("event_data"),
            F.lit("Network error").alias("failure_reason"),
            F.col("ts").cast("timestamp").alias("created_at"),
            (F.col("event_id") % 5).cast("int").alias("retry_count"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one retry run; a quarter of the entries got none, a quarter a NULL."""
    reply = F.col("user_id") % 4
    return (
        events(spark, sf_dir)
        .filter((F.col("event_type") == "error") & (reply != 3))
        .select(
            F.col("event_id").alias("id"),
            F.when(reply == 0, 200).when(reply == 1, 202 + 298 * (F.col("event_id") % 2)).cast("int").alias("status_code"),
        )
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the players of two teams."""
    spot = F.col("c_custkey") % 10
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        (F.col("c_nationkey") % 2 + 1).cast("int").alias("team_id"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(spot == 0, "gk").when(spot <= 4, "def").when(spot <= 7, "mid").otherwise("fwd").alias("position"),
    )
