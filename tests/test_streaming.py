"""Streams: ingest, consume with failures, idempotent sinks, live counts."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import table_inputs as E
from touchline.operators.decode import decode_envelopes
from touchline.operators.encode import publish_rows, storage_rows
from touchline.operators.match_counts import events_by_type
from touchline.plans.match_metrics import minute_cells
from touchline.schema import TOPIC
from touchline.sources.tables import read_match_events, read_raw_event_stream, write_clustered
from touchline.sources.topics import append_to_topic, kafka_options, read_topic, read_topic_stream
from touchline.streaming.consumer import Outputs, consume_batch, live_lag, start_consumer, stop_gracefully
from touchline.streaming.ingest import ingest_batch, start_ingest
from touchline.streaming.live import latest_cells, live_minute_cells, start_live_cells
from touchline.streaming.sinks import distinct_match_events_sink, drop, match_events_sink, parquet_batches

SF = "/root/testdata/sf0.001"


def as_set(df):
    return {tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()}


def down(rows, batch_id):
    raise ConnectionError("store is down")


def audit_of(spark, path):
    return {r["outcome"]: r["rows"] for r in spark.read.parquet(path).collect()}


def test_kafka_options_follow_the_batch_rule():
    options = kafka_options("host:9092", "events", max_rows_per_batch=50_000)
    assert int(kafka_options("host:9092", "events")["maxOffsetsPerTrigger"]) > 0
    assert options["startingOffsets"] == "earliest"
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"]) == ("1000", "5 seconds")
    assert options["maxOffsetsPerTrigger"] == "50000"


def test_raw_text_to_table(spark, tmp_path):
    raw = E.raw_documents(spark, SF)
    raw.select("value").repartition(3).write.text(f"{tmp_path}/raw")
    start_ingest(
        read_raw_event_stream(spark, f"{tmp_path}/raw", 1),
        parquet_batches(f"{tmp_path}/topic"),
        f"{tmp_path}/c1",
        parquet_batches(f"{tmp_path}/rejects"),
        available_now=True,
    ).awaitTermination()
    outputs = Outputs(match_events_sink(f"{tmp_path}/table"), audit=parquet_batches(f"{tmp_path}/audit"))
    start_consumer(
        read_topic_stream(spark, f"{tmp_path}/topic"), outputs, f"{tmp_path}/c2", available_now=True
    ).awaitTermination()
    total, rejects = raw.count(), spark.read.parquet(f"{tmp_path}/rejects").count()
    stored = read_match_events(spark, f"{tmp_path}/table")
    assert stored.count() + rejects == total and rejects > 0
    assert audit_of(spark, f"{tmp_path}/audit") == {"success": stored.count()}
    good = E.valid_events(spark, SF, "seq").filter("seq % 16 not in (0,1,2,3,4,5,6,7,10)")
    assert as_set(events_by_type(stored)) == as_set(events_by_type(good))


def test_repeated_batch_is_stored_once(spark, tmp_path):
    batch = publish_rows(E.valid_events(spark, SF))
    for _ in range(2):
        consume_batch(batch, 7, Outputs(match_events_sink(f"{tmp_path}/table", writer="one")))
    assert read_match_events(spark, f"{tmp_path}/table").count() == batch.count()


def test_writers_with_their_own_checkpoints_add_up(spark, tmp_path):
    rows = publish_rows(E.valid_events(spark, SF))
    append_to_topic(rows, f"{tmp_path}/topic")
    for checkpoint in ("c1", "c2", "c1"):
        start_consumer(
            read_topic_stream(spark, f"{tmp_path}/topic"), Outputs(match_events_sink(f"{tmp_path}/table")),
            f"{tmp_path}/{checkpoint}", available_now=True,
        ).awaitTermination()
    assert read_match_events(spark, f"{tmp_path}/table").count() == 2 * rows.count()


def test_a_sink_outside_of_a_stream_needs_a_writer(spark, tmp_path):
    with pytest.raises(ValueError, match="writer"):
        parquet_batches(f"{tmp_path}/x")(spark.range(1), 0)


def test_a_batch_writes_one_file_per_date(spark, tmp_path):
    batch = publish_rows(E.valid_events(spark, SF)).repartition(6)
    consume_batch(batch, 0, Outputs(match_events_sink(f"{tmp_path}/table", writer="one")))
    dates = read_match_events(spark, f"{tmp_path}/table").select("event_date").distinct().count()
    assert len(list((tmp_path / "table").rglob("*.parquet"))) == dates > 20


def test_restart_continues_after_the_last_batch(spark, tmp_path):
    rows = publish_rows(E.valid_events(spark, SF))
    outputs = Outputs(match_events_sink(f"{tmp_path}/table"))
    for _ in range(2):
        append_to_topic(rows, f"{tmp_path}/topic")
        start_consumer(
            read_topic_stream(spark, f"{tmp_path}/topic"), outputs, f"{tmp_path}/c", available_now=True
        ).awaitTermination()
    # No de-duplication: an event published twice counts twice.
    assert read_match_events(spark, f"{tmp_path}/table").count() == 2 * rows.count()


@pytest.fixture()
def failing(spark, tmp_path):
    """Runs one batch against a store that is down; returns what was written where."""
    topic = E.topic_rows(spark, SF)

    def run(retry=True, dead=True, retry_sink=None, with_audit=True):
        outputs = Outputs(
            down,
            retry=(retry_sink or parquet_batches(f"{tmp_path}/retry", writer="t")) if retry else None,
            dead=drop if dead is drop else parquet_batches(f"{tmp_path}/dead", writer="t") if dead else None,
            audit=parquet_batches(f"{tmp_path}/audit", writer="t") if with_audit else None,
        )
        consume_batch(topic, 0, outputs)
        counts = {r["outcome"]: r["rows"] for r in spark.read.parquet(f"{tmp_path}/audit").collect()} if with_audit else None
        written = {
            name: spark.read.parquet(f"{tmp_path}/{name}").count()
            for name in ("retry", "dead")
            if (tmp_path / name).exists()
        }
        return counts, written

    return run


def test_failed_batch_is_routed(failing):
    counts, written = failing()
    assert counts == {"retry": 800, "dead": 200} and written == {"retry": 800, "dead": 200}


def test_failed_batch_without_audit(failing):
    assert failing(with_audit=False)[1] == {"retry": 800, "dead": 200}


def test_failed_batch_without_retry(failing):
    assert failing(retry=False) == ({"dead": 1000}, {"dead": 1000})


def test_dropping_failed_rows_is_a_choice_and_is_counted(failing):
    assert failing(retry=False, dead=drop) == ({"lost": 1000}, {})
    with pytest.raises(ConnectionError):
        failing(retry=False, dead=False)


def test_rows_out_of_tries_need_a_dead_letter_output(failing):
    with pytest.raises(ValueError, match="dead-letter"):
        failing(dead=False)


def test_failed_retry_write_goes_to_dead_once(failing):
    assert failing(retry_sink=down) == ({"dead": 1000}, {"dead": 1000})


def test_failed_dead_letter_write_stops_the_batch(spark):
    outputs = Outputs(down, dead=down)
    with pytest.raises(ConnectionError):
        consume_batch(E.topic_rows(spark, SF), 0, outputs)


def test_broken_messages_are_dropped_counted_and_quarantined(spark, tmp_path):
    values = [("not json",), (json.dumps({"eventId": "x"}),)]
    topic = spark.createDataFrame(values, "v string").select(F.col("v").cast("binary").alias("value"))
    outputs = Outputs(
        match_events_sink(f"{tmp_path}/table", writer="t"),
        audit=parquet_batches(f"{tmp_path}/audit", writer="t"),
        quarantine=parquet_batches(f"{tmp_path}/bad", writer="t"),
    )
    assert consume_batch(topic, 0, outputs) == {"parse_error": 2}
    assert audit_of(spark, f"{tmp_path}/audit") == {"parse_error": 2}
    assert {bytes(r["value"]).decode() for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {v for (v,) in values}
    assert read_match_events(spark, f"{tmp_path}/table").isEmpty()
    with pytest.raises(ValueError, match="quarantine"):
        consume_batch(topic, 0, Outputs(match_events_sink(f"{tmp_path}/other", writer="t")))
    dropping = Outputs(match_events_sink(f"{tmp_path}/other", writer="t"), quarantine=drop)
    assert consume_batch(topic, 0, dropping) == {"parse_error": 2}


def test_a_fault_of_the_query_is_not_routed(spark, tmp_path):
    def wrong(rows, batch_id):
        rows.select("no_such_column")

    routed = []
    outputs = Outputs(wrong, dead=lambda rows, batch_id: routed.append(batch_id))
    with pytest.raises(AnalysisException):
        consume_batch(E.topic_rows(spark, SF), 0, outputs)
    assert not routed


def test_rejected_documents_are_always_counted(spark, tmp_path):
    raw = E.raw_documents(spark, SF)
    counts = ingest_batch(raw, 0, parquet_batches(f"{tmp_path}/topic", writer="t"), drop)
    assert counts == {"accepted": spark.read.parquet(f"{tmp_path}/topic").count(), "rejected": raw.filter("doc_id % 16 in (0,1,2,3,4,5,6,7,10)").count()}


def test_graceful_stop_processes_what_arrived(spark, tmp_path):
    append_to_topic(publish_rows(E.valid_events(spark, SF)), f"{tmp_path}/topic")
    query = start_consumer(
        read_topic_stream(spark, f"{tmp_path}/topic"), Outputs(match_events_sink(f"{tmp_path}/table")), f"{tmp_path}/c"
    )
    stop_gracefully(query)
    assert not query.isActive and live_lag(query) == []
    assert read_match_events(spark, f"{tmp_path}/table").count() == 1000


def test_live_counts_equal_batch_counts_in_any_order(spark, tmp_path):
    valid = E.valid_events(spark, SF)
    publish_rows(valid).orderBy(F.rand(3)).repartition(5).write.parquet(f"{tmp_path}/topic")
    events = decode_envelopes(read_topic_stream(spark, f"{tmp_path}/topic", 1)).filter(~F.col("parse_error"))
    start_live_cells(live_minute_cells(events), f"{tmp_path}/cells", f"{tmp_path}/c", True).awaitTermination()
    versions = spark.read.parquet(f"{tmp_path}/cells")
    assert versions.select("batch_id").distinct().count() > 1
    assert as_set(latest_cells(versions)) == as_set(minute_cells(valid))


def week(n):
    return F.least(F.floor(F.dayofmonth("timestamp") / 8), F.lit(3)) == n


def test_a_watermark_drops_what_comes_too_late(spark, tmp_path):
    rows = publish_rows(E.valid_events(spark, SF))
    # The last week comes first, so that the weeks before it are late for a delay of ten days.
    for batch, n in enumerate((3, 2, 1, 0)):
        append_to_topic(rows.filter(week(n)).coalesce(1), f"{tmp_path}/topic/{batch}")
        events = decode_envelopes(read_topic_stream(spark, f"{tmp_path}/topic", 1)).filter(~F.col("parse_error"))
        cells = live_minute_cells(events, "10 days")
        start_live_cells(cells, f"{tmp_path}/cells", f"{tmp_path}/c", True).awaitTermination()
    found = as_set(latest_cells(spark.read.parquet(f"{tmp_path}/cells")).select("match_id", "minute", "event_type", "event_count", "first_event_at", "last_event_at"))
    last = E.valid_events(spark, SF)
    newest = last.agg(F.max("timestamp")).first()[0]
    in_time = last.filter(week(3) | (F.col("timestamp") > F.lit(newest) - F.expr("interval 10 days")))
    assert found == as_set(minute_cells(in_time)) and len(found) < minute_cells(last).count()


def test_repeats_are_stored_once_however_late(spark, tmp_path):
    rows = publish_rows(E.valid_events(spark, SF))
    # Newest first; every batch brings one week and, again, half of everything.
    for batch, n in enumerate((3, 2, 1, 0)):
        again = rows.filter(F.xxhash64("value") % 2 == 0)
        append_to_topic(rows.filter(week(n)).unionByName(again).coalesce(1), f"{tmp_path}/topic/{batch}")
        outputs = Outputs(distinct_match_events_sink(f"{tmp_path}/table"))
        start_consumer(
            read_topic_stream(spark, f"{tmp_path}/topic", 1), outputs, f"{tmp_path}/c", available_now=True
        ).awaitTermination()
    stored = read_match_events(spark, f"{tmp_path}/table")
    assert stored.count() == stored.select("event_id").distinct().count() == 1000


def test_a_repeated_batch_keeps_its_distinct_rows(spark, tmp_path):
    batch = publish_rows(E.valid_events(spark, SF))
    for batch_id in (4, 4, 5):
        consume_batch(batch, batch_id, Outputs(distinct_match_events_sink(f"{tmp_path}/table", writer="t")))
    assert read_match_events(spark, f"{tmp_path}/table").count() == 1000


def test_topic_rows_come_back_as_they_went(spark, tmp_path):
    rows = E.topic_rows(spark, SF)
    append_to_topic(rows, f"{tmp_path}/topic")
    back = read_topic(spark, f"{tmp_path}/topic")
    assert back.schema.fieldNames() == TOPIC.fieldNames() and as_set(back) == as_set(rows.select(*TOPIC.fieldNames()))


def test_clustered_rewrite_keeps_all_rows(spark, tmp_path):
    rows = storage_rows(E.valid_events(spark, SF))
    write_clustered(rows, f"{tmp_path}/table")
    assert as_set(read_match_events(spark, f"{tmp_path}/table")) == as_set(rows)
    one_day = read_match_events(spark, f"{tmp_path}/table", "2024-01-05", "2024-01-06")
    assert {str(r[0]) for r in one_day.select("event_date").distinct().collect()} == {"2024-01-05", "2024-01-06"}


def test_live_lag_of_a_topic():
    class Running:
        class lastProgress:  # noqa: N801
            json = json.dumps(
                {
                    "sources": [
                        {"endOffset": {"a": {"0": 5, "1": 7}}, "latestOffset": {"a": {"0": 9, "1": 7, "2": 3}}},
                        {"endOffset": None, "latestOffset": {"b": {"0": 4}}},
                        {"endOffset": {"logOffset": 3}, "latestOffset": None},
                    ]
                }
            )

    assert live_lag(Running()) == [("a", 0, 4), ("a", 1, 0), ("a", 2, 3), ("b", 0, 4)]
    Running.lastProgress = None
    assert live_lag(Running()) == []


def test_a_topic_file_is_shared_by_many_tasks(spark, tmp_path):
    value = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 512) for i in range(8)])
    rows = spark.range(0, 30_000, 1, 1).select(value.cast("binary").alias("value"))
    append_to_topic(rows, f"{tmp_path}/topic")
    parts = read_topic(spark, f"{tmp_path}/topic").select("value").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(parts) == 30_000 and sum(n > 0 for n in parts) >= 3
