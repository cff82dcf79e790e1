
from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import table_inputs as E
from oracle_queries import ORACLES
from touchline.operators import ledger as L
from touchline.operators import match_counts as M
from touchline.operators.decode import decode_documents, decode_envelopes
from touchline.operators.encode import (
    dead_letter_rows,
    envelope_json,
    publish_rows,
    receipts,
    retry_rows,
    storage_rows,
)
from touchline.operators.lineup import quota_sample, with_position
from touchline.operators.log_histogram import HistogramTable, percentiles_of
from touchline.operators.newest import newest
from touchline.operators.percentiles import exact_percentiles, latency_percentiles
from touchline.operators.request_stats import error_rate, histogram, labelled_counts, path_template
from touchline.operators.routing import (
    DEAD,
    RETRY,
    attempts_so_far,
    batch_audit,
    consumer_lag,
    header_value,
    replay_rows,
    route_failed,
)
from touchline.operators.validate import accepted, error_response, error_text, rejected, validate
from touchline.plans import match_metrics as P
from touchline.schema import (
    BATCH_ROWS_BUCKETS,
    CONSUME_SECONDS_BUCKETS,
    MESSAGE_BYTES_BUCKETS,
    QUERY_SECONDS_BUCKETS,
    REQUEST_SECONDS_BUCKETS,
    TEAM_IDS,
)
from touchline.session import configure, new_run_dir
from touchline.sources.ledger_versions import VersionedLedger
from touchline.sources.tables import (
    read_ledger,
    read_match_events,
    read_raw_event_stream,
    read_raw_events,
    read_roster,
    write_clustered,
)
from touchline.sources.topics import append_to_topic, read_topic, read_topic_stream
from touchline.streaming.consumer import Outputs, start_consumer
from touchline.streaming.ingest import start_ingest
from touchline.streaming.live import (
    counted_cells,
    fold_deltas,
    latest_cells,
    live_minute_cells,
    start_cell_deltas,
    start_live_cells,
)
from touchline.streaming.measures import message_counters, read_measures, timed
from touchline.streaming.newest import NewestTable, start_newest
from touchline.streaming.sinks import (
    committed_match_events,
    committed_sink,
    distinct_match_events_sink,
    match_events_sink,
    parquet_batches,
)

ONE_MATCH = "match-2024-01-05-1"
SEED = 7
FIXED_TIME = "2024-02-01 12:00:00"


def _naive(df: DataFrame) -> DataFrame:
    """Timestamps without zone, the type the comparison engine has."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _fixed_time() -> Column:
    return F.lit(FIXED_TIME).cast("timestamp")


# -- counts per match ---------------------------------------------------------------


def match_summary(spark, sf):
    return M.match_summary(E.match_events(spark, sf))


def match_summary_one(spark, sf):
    return M.match_summary(E.match_events(spark, sf), ONE_MATCH)


def events_by_type(spark, sf):
    return M.events_by_type(E.match_events(spark, sf))


def events_by_type_one(spark, sf):
    return M.events_by_type(E.match_events(spark, sf), ONE_MATCH)


def events_by_type_map(spark, sf):
    maps = M.events_by_type_map(E.match_events(spark, sf))
    return maps.withColumn("events_by_type", F.to_json("events_by_type"))


def events_per_minute(spark, sf):
    return M.events_per_minute(E.match_events(spark, sf))


def events_per_minute_one(spark, sf):
    return M.events_per_minute(E.match_events(spark, sf), ONE_MATCH)


def minute_totals(spark, sf):
    return M.minute_totals(E.match_events(spark, sf))


def peak_minute(spark, sf):
    return M.peak_minute(E.match_events(spark, sf))


def match_activity(spark, sf):
    activity = M.match_activity(E.match_events(spark, sf))
    return activity.withColumn("events_per_minute", F.to_json("events_per_minute"))


# -- the metrics row ----------------------------------------------------------------


def _flat(metrics: DataFrame) -> DataFrame:
    extra = []
    if "response_time_percentiles" in metrics.columns:
        extra = [F.col(f"response_time_percentiles.{p}").alias(p) for p in ("p50", "p95", "p99")]
    return metrics.select(
        "match_id",
        "total_events",
        F.to_json("events_by_type").alias("events_by_type"),
        "goals",
        "yellow_cards",
        "red_cards",
        "first_event_at",
        "last_event_at",
        F.col("peak_minute.minute").alias("peak_minute"),
        F.col("peak_minute.event_count").alias("peak_count"),
        *extra,
    )


def match_metrics(spark, sf):
    return _flat(P.match_metrics(E.match_events(spark, sf)))


def match_metrics_one(spark, sf):
    return _flat(P.match_metrics(E.match_events(spark, sf), ONE_MATCH))


def match_metrics_json(spark, sf):
    return P.metrics_json(P.match_metrics(E.match_events(spark, sf)))


def match_metrics_with_latency(spark, sf):
    metrics = P.match_metrics(E.match_events(spark, sf))
    return _flat(P.with_latency(metrics, latency_percentiles(E.latency_samples(spark, sf))))


def minute_rollup(spark, sf):
    return P.minute_cells(E.match_events(spark, sf))


def rollup_equals_base(spark, sf):
    """Metrics from a stored roll-up that was built in two halves and merged."""
    path = new_run_dir(spark, "rollup")
    rows = E.match_events(spark, sf)
    first_half = F.dayofmonth("timestamp") <= 15
    for part, chosen in (("a", first_half), ("b", ~first_half)):
        P.minute_cells(rows.filter(chosen)).write.parquet(f"{path}/part={part}")
    cells = spark.read.parquet(path).drop("part")
    return _flat(P.match_metrics_from_cells(P.merge_cells(cells)))


# -- latency and request statistics ---------------------------------------------------


def latency(spark, sf):
    return latency_percentiles(E.latency_samples(spark, sf), n=5000)


def latency_by_type(spark, sf):
    return latency_percentiles(E.latency_samples(spark, sf), by=["event_type"], n=1500)


def percentile_exact(spark, sf):
    wanted = {"p25": 25, "p50": 50, "p75": 75, "p95": 95, "p99": 99}
    return exact_percentiles(E.latency_samples(spark, sf), "duration_ms", wanted, by=["event_type"])


def percentile_exact_all(spark, sf):
    return exact_percentiles(E.latency_samples(spark, sf), "duration_ms", {"p50": 50, "p95": 95, "p99": 99})


def latest_n(spark, sf):
    return newest(E.latency_samples(spark, sf), ["ts", "seq"], 5000)


def latest_n_per_key(spark, sf):
    return newest(E.latency_samples(spark, sf), ["ts", "seq"], 100, by=["event_type"])


def request_counters(spark, sf):
    return labelled_counts(E.request_log(spark, sf), "method", "path", "status", name="requests")


def request_counters_by_template(spark, sf):
    log = E.request_log(spark, sf).withColumn("template", path_template(F.col("path")))
    return labelled_counts(log, "method", "template", "status", name="requests")


def ingest_counters(spark, sf):
    return labelled_counts(E.match_events(spark, sf), "event_type", name="events_ingested")


def request_error_rate(spark, sf):
    return error_rate(E.request_log(spark, sf), "method")


def _rounded_sum(df: DataFrame) -> DataFrame:
    return df.withColumn("value_sum", F.round("value_sum", 4))


def request_histogram(spark, sf):
    return _rounded_sum(histogram(E.request_log(spark, sf), "duration_s", REQUEST_SECONDS_BUCKETS, ["method"]))


def query_histogram(spark, sf):
    return _rounded_sum(histogram(E.request_log(spark, sf), "duration_s", QUERY_SECONDS_BUCKETS))


def batch_histograms(spark, sf):
    """Rows and duration per batch of 1,000 source rows."""
    batches = (
        E.events(spark, sf)
        .groupBy(F.floor(F.col("event_id") / E.ROWS_PER_BATCH).alias("batch_id"))
        .agg(F.count("*").alias("rows"), (F.max("value") / 100).alias("duration_s"))
    )
    rows = histogram(batches, "rows", BATCH_ROWS_BUCKETS).withColumn("measure", F.lit("rows"))
    seconds = histogram(batches, "duration_s", CONSUME_SECONDS_BUCKETS).withColumn("measure", F.lit("duration_s"))
    return _rounded_sum(rows.withColumn("value_sum", F.col("value_sum").cast("double")).unionByName(seconds))


def message_size_histogram(spark, sf):
    sizes = E.valid_events(spark, sf).select("event_type", F.octet_length(envelope_json()).alias("bytes"))
    return histogram(sizes, "bytes", MESSAGE_BYTES_BUCKETS, ["event_type"])


# -- decode, validate, encode -----------------------------------------------------------


def _validated(spark, sf):
    return validate(decode_documents(E.raw_documents(spark, sf)))


def validate_first_error(spark, sf):
    return _validated(spark, sf).select("doc_id", "malformed", "error_field", "error_message")


def validate_valid_rows(spark, sf):
    rows = accepted(_validated(spark, sf), "doc_id")
    return rows.withColumn("metadata", F.to_json("metadata"))


def reject_counts(spark, sf):
    return labelled_counts(_validated(spark, sf), "error_field", "error_message", name="documents")


def error_texts(spark, sf):
    field, message = F.col("error_field"), F.col("error_message")
    return rejected(_validated(spark, sf), "doc_id").select(
        "doc_id",
        F.when(field.isNotNull(), error_text(field, message)).alias("error_text"),
        error_response(field, message).alias("response"),
    )


def storage_projection(spark, sf):
    return storage_rows(E.valid_events(spark, sf))


def metadata_json(spark, sf):
    """Metadata at rest for documents that carry it, carry null, or were accepted with trailing text."""
    return storage_rows(accepted(_validated(spark, sf))).select("event_id", "metadata")


def envelope_encode(spark, sf):
    return E.valid_events(spark, sf).select("event_id", envelope_json().alias("envelope"))


def envelope_roundtrip(spark, sf):
    published = publish_rows(E.valid_events(spark, sf))
    rows = decode_envelopes(published).filter(~F.col("parse_error"))
    return storage_rows(rows)


def envelope_decode_errors(spark, sf):
    return decode_envelopes(E.raw_documents(spark, sf)).select("doc_id", "parse_error", "event_id", "match_id", "team_id")


def publish(spark, sf):
    return publish_rows(E.valid_events(spark, sf)).select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        header_value(F.col("headers"), "event_type").cast("string").alias("event_type"),
        header_value(F.col("headers"), "event_id").cast("string").alias("event_id"),
        "topic",
        "timestamp",
    )


def acceptance_receipts(spark, sf):
    return receipts(accepted(_validated(spark, sf)), _fixed_time())


# -- routing ----------------------------------------------------------------------------


def _routed(spark, sf):
    return route_failed(decode_envelopes(E.topic_rows(spark, sf)))


def retry_route(spark, sf):
    return _routed(spark, sf).select("event_id", "retry_count", "route")


def route_without_outputs(spark, sf):
    topic = decode_envelopes(E.topic_rows(spark, sf))
    no_retry = route_failed(topic, retry_available=False).withColumn("case", F.lit("no_retry"))
    neither = route_failed(topic, retry_available=False, dead_available=False).withColumn("case", F.lit("neither"))
    no_dead = route_failed(topic, dead_available=False).withColumn("case", F.lit("no_dead"))
    return labelled_counts(no_retry.unionByName(neither).unionByName(no_dead), "case", "route", name="rows")


def _retry_text(rows: DataFrame) -> DataFrame:
    headers = F.col("headers")
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        header_value(headers, "event_type").cast("string").alias("event_type"),
        header_value(headers, "event_id").cast("string").alias("event_id"),
        attempts_so_far(headers).alias("retry_count"),
        header_value(headers, "original_timestamp").cast("string").alias("original_timestamp"),
        "topic",
    )


def retries(spark, sf):
    return _retry_text(retry_rows(_routed(spark, sf).filter(F.col("route") == RETRY)))


def replay(spark, sf):
    """Second failure of the rows retried once: replayed with their count, so it goes up again."""
    again = replay_rows(retry_rows(_routed(spark, sf).filter(F.col("route") == RETRY)))
    return route_failed(decode_envelopes(again)).select("event_id", "retry_count", "route")


def dead_letters(spark, sf):
    rows = dead_letter_rows(_routed(spark, sf).filter(F.col("route") == DEAD), _fixed_time())
    headers = F.col("headers")
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        header_value(headers, "event_type").cast("string").alias("event_type"),
        header_value(headers, "event_id").cast("string").alias("event_id"),
        header_value(headers, "failed_at").cast("string").alias("failed_at"),
        "topic",
    )


def audit(spark, sf):
    """Outcome counts per batch of 1,000 documents, every seventh batch failing to store."""
    batch = F.floor(F.col("doc_id") / E.ROWS_PER_BATCH)
    decoded = decode_envelopes(E.raw_documents(spark, sf)).withColumn("batch_id", batch)
    outcome = (
        F.when(F.col("parse_error"), "parse_error").when(F.col("batch_id") % 7 == 3, RETRY).otherwise("success")
    )
    return batch_audit(decoded.withColumn("outcome", outcome), "batch_id")


def lag(spark, sf):
    """Lag against commits at the highest offset of the first three weeks, one partition uncommitted."""
    topic = E.topic_rows(spark, sf)
    consumed = topic.filter((F.dayofmonth("timestamp") <= 21) & (F.col("partition") != 2))
    committed = consumed.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed_offset"))
    return consumer_lag(topic, committed)


# -- ledger and line-ups ------------------------------------------------------------------


def _run(spark, sf):
    return L.retry_run(E.ledger(spark, sf), E.outcomes(spark, sf))


def ledger_transition(spark, sf):
    return L.ledger_after(_run(spark, sf))


def ledger_summary(spark, sf):
    return L.run_summary(_run(spark, sf))


def ledger_eligible(spark, sf):
    return L.oldest_first(L.eligible(E.ledger(spark, sf)))


def ledger_append(spark, sf):
    """Ledger rows for the requests that were refused, identifiers left out."""
    log = E.request_log(spark, sf).filter(F.col("status") >= 400)
    reason = F.when(F.col("status") >= 500, F.format_string("HTTP %s: ", F.col("status").cast("string")))
    rows = L.new_entries(log, F.to_json(F.struct("method", "path")), reason, now=_fixed_time())
    return rows.groupBy("event_data", "failure_reason", "created_at", "retry_count").agg(
        F.count_distinct("id").alias("entries")
    )


def delivery_counts(spark, sf):
    return L.delivery_counts(E.request_log(spark, sf).withColumnRenamed("status", "status_code"), "path")


def _quotas(spark, sf):
    """A tenth of the players of each team and position, rounded up."""
    counts = E.roster(spark, sf).groupBy("team_id", "position").agg(F.count("*").alias("n"))
    return counts.select("team_id", "position", F.ceil(F.col("n") / 10).cast("int").alias("quota"))


def stratified_sample(spark, sf):
    return quota_sample(E.roster(spark, sf), _quotas(spark, sf), ["team_id", "position"], "id", SEED)


def goalkeepers(spark, sf):
    return with_position(E.roster(spark, sf), "gk")


# -- streams ------------------------------------------------------------------------------


def _drained(query) -> None:
    query.awaitTermination()


def stream_ingest_counts(spark, sf):
    """Raw text -> validated topic -> match_events, both as streams; stored rows by match and type."""
    run = new_run_dir(spark, "ingest")
    E.raw_documents(spark, sf).select("value").write.text(f"{run}/raw")
    raw = read_raw_event_stream(spark, f"{run}/raw")
    _drained(
        start_ingest(
            raw, parquet_batches(f"{run}/topic"), f"{run}/ckpt-ingest", parquet_batches(f"{run}/rejects"), True
        )
    )
    topic = read_topic_stream(spark, f"{run}/topic")
    _drained(start_consumer(topic, Outputs(match_events_sink(f"{run}/table")), f"{run}/ckpt-consume", available_now=True))
    return M.events_by_type(read_match_events(spark, f"{run}/table"))


def stream_outcomes(spark, sf):
    """A consumer whose store is down: audit of parse errors, retries and dead letters."""
    run = new_run_dir(spark, "outcomes")
    good = E.topic_rows(spark, sf)
    documents = decode_envelopes(E.raw_documents(spark, sf))
    broken = documents.filter("parse_error").select(F.col("value").cast("binary").alias("value"))
    append_to_topic(good, f"{run}/topic")
    append_to_topic(broken, f"{run}/topic")

    def unavailable(rows: DataFrame, batch_id: int) -> None:
        raise ConnectionError("store is down")

    outputs = Outputs(
        unavailable,
        retry=parquet_batches(f"{run}/retry"),
        dead=parquet_batches(f"{run}/dead"),
        audit=parquet_batches(f"{run}/audit"),
        quarantine=parquet_batches(f"{run}/quarantine"),
    )
    _drained(start_consumer(read_topic_stream(spark, f"{run}/topic"), outputs, f"{run}/ckpt", available_now=True))
    told = spark.read.parquet(f"{run}/audit").groupBy("outcome").agg(F.sum("rows").alias("audited"))
    written = None
    for outcome, folder in (("retry", "retry"), ("dead", "dead"), ("parse_error", "quarantine")):
        rows = spark.read.parquet(f"{run}/{folder}").agg(F.count("*").alias("written"))
        rows = rows.withColumn("outcome", F.lit(outcome))
        written = rows if written is None else written.unionByName(rows)
    return told.join(written, "outcome").select("outcome", "audited", "written")


def stream_minute_counts(spark, sf):
    """Live minute counts fed by the topic in several batches, in an order unrelated to time."""
    run = new_run_dir(spark, "live")
    publish_rows(E.valid_events(spark, sf)).repartition(4).write.parquet(f"{run}/topic")
    events = decode_envelopes(read_topic_stream(spark, f"{run}/topic", max_files_per_trigger=1))
    cells = live_minute_cells(events.filter(~F.col("parse_error")))
    _drained(start_live_cells(cells, f"{run}/cells", f"{run}/ckpt", available_now=True))
    return latest_cells(spark.read.parquet(f"{run}/cells"))


def _published(spark, sf, run, parts, keep):
    """Every event in a topic of ``parts`` appends, newest part first; a part takes the events that ``keep`` names."""
    rows = E.valid_events(spark, sf, "seq")
    for part in reversed(range(parts)):
        append_to_topic(publish_rows(rows.filter(keep(part))), f"{run}/topic/{parts - part}")


def stream_two_writers(spark, sf):
    """Two consumers with checkpoints of their own store halves of the topic in one table."""
    run = new_run_dir(spark, "writers")
    rows = E.valid_events(spark, sf, "seq")
    for half in (0, 1):
        append_to_topic(publish_rows(rows.filter(F.col("seq") % 2 == half)), f"{run}/topic-{half}")
        topic = read_topic_stream(spark, f"{run}/topic-{half}")
        outputs = Outputs(match_events_sink(f"{run}/table"))
        _drained(start_consumer(topic, outputs, f"{run}/ckpt-{half}", available_now=True))
    return M.events_by_type(read_match_events(spark, f"{run}/table"))


def stream_distinct(spark, sf):
    """Every event comes at least twice over four batches, newest week first; each is stored once."""
    run = new_run_dir(spark, "distinct")
    week = F.least(F.floor(F.dayofmonth("timestamp") / 8), F.lit(3))
    # Each part holds one week, and every part once more the events with an even number of all weeks.
    _published(spark, sf, run, 4, lambda part: (week == part) | (F.col("seq") % 2 == 0))
    topic = read_topic_stream(spark, f"{run}/topic", max_files_per_trigger=1)
    outputs = Outputs(distinct_match_events_sink(f"{run}/table"))
    _drained(start_consumer(topic, outputs, f"{run}/ckpt", available_now=True))
    return M.events_by_type(read_match_events(spark, f"{run}/table"))


def stream_audit_counters(spark, sf):
    """Rows and batches by outcome, from the audit that a consumer wrote of good and unreadable rows."""
    run = new_run_dir(spark, "audit")
    documents = E.raw_documents(spark, sf).select(F.col("value").cast("binary").alias("value"))
    append_to_topic(documents, f"{run}/topic")
    outputs = Outputs(
        match_events_sink(f"{run}/table"),
        audit=parquet_batches(f"{run}/audit"),
        quarantine=parquet_batches(f"{run}/quarantine"),
    )
    _drained(start_consumer(read_topic_stream(spark, f"{run}/topic"), outputs, f"{run}/ckpt", available_now=True))
    rows = spark.read.parquet(f"{run}/audit")
    return rows.groupBy("outcome").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"))


def _batches(rows, parts):
    """The rows dealt to batches by a hash of the event, all dates in each."""
    return [rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part) for part in range(parts)]


def committed_repeat(spark, sf):
    """Batches stored under a commit log while a reader holds an earlier version; two of them come again."""
    table = committed_match_events(spark, new_run_dir(spark, "committed"))
    batches = _batches(storage_rows(E.valid_events(spark, sf)), 3)
    readers = []
    for batch in (0, 1, 0, 1, 2):
        table.append(batches[batch], "one", batch)
        readers.append(table.read())
    # Rows of the version after the first batch, of that after its repeat, and of the last.
    seen = [r.groupBy("event_type").agg(F.count("*").alias(n)) for r, n in zip(readers[::2], ("first", "again", "last"))]
    return seen[2].join(seen[0], "event_type", "left").join(seen[1], "event_type", "left").select(
        "event_type", F.col("last").alias("events"), (F.coalesce("first", F.lit(0)) <= F.coalesce("again", F.lit(0))).alias("grown")
    )


def compacted_dates(spark, sf):
    """Every date in four batches, compacted while a fifth is stored: rows and files of each date."""
    table = committed_match_events(spark, new_run_dir(spark, "compacted"))
    batches = _batches(storage_rows(E.valid_events(spark, sf)), 5)
    for batch in range(4):
        table.append(batches[batch], "one", batch)
    table.compact()
    version = table.append(batches[4], "one", 4)
    files = [(date, len(table.manifest(version, date))) for date in sorted(version.dates)]
    counted = table.read(version=version).groupBy("event_date").agg(F.count("*").alias("events"))
    held = spark.createDataFrame(files, "date string, files int")
    return counted.join(F.broadcast(held), F.col("event_date").cast("string") == F.col("date")).select(
        "event_date", "events", (F.col("files") <= 2).alias("packed")
    )


def stream_distinct_committed(spark, sf):
    """As stream_distinct, the repeats looked for only in files that may hold them."""
    run = new_run_dir(spark, "distinct-committed")
    week = F.least(F.floor(F.dayofmonth("timestamp") / 8), F.lit(3))
    _published(spark, sf, run, 4, lambda part: (week == part) | (F.col("seq") % 2 == 0))
    topic = read_topic_stream(spark, f"{run}/topic", max_files_per_trigger=2)
    outputs = Outputs(committed_sink(f"{run}/table", distinct=True))
    _drained(start_consumer(topic, outputs, f"{run}/ckpt", available_now=True))
    return M.events_by_type(committed_match_events(spark, f"{run}/table").read())


def stream_cell_deltas(spark, sf):
    """Live minute counts without state: newest week first in several batches, changes folded half way."""
    run = new_run_dir(spark, "deltas")
    week = F.least(F.floor(F.dayofmonth("timestamp") / 8), F.lit(3))
    _published(spark, sf, run, 4, lambda part: week == part)
    events = decode_envelopes(read_topic_stream(spark, f"{run}/topic", max_files_per_trigger=2)).filter(~F.col("parse_error"))
    _drained(start_cell_deltas(events, f"{run}/cells", f"{run}/ckpt", available_now=True))
    fold_deltas(spark, f"{run}/cells", before="2024-01-16")
    return counted_cells(spark, f"{run}/cells")


def _newest_streamed(spark, sf, n):
    """Samples arriving newest week first in four batches, folded after every second."""
    run = new_run_dir(spark, "newest")
    samples = E.latency_samples(spark, sf)
    week = F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(3))
    for part in reversed(range(4)):
        samples.filter(week == part).write.mode("append").parquet(f"{run}/samples/part={3 - part}")
    rows = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 2).parquet(f"{run}/samples/*")
    table = NewestTable(spark, f"{run}/newest", samples.schema, ["ts", "seq"], ["event_type"], n, buckets=4)
    _drained(start_newest(rows, table, f"{run}/ckpt", fold_every=2, available_now=True))
    return table


def stream_latest_n_per_key(spark, sf):
    """The newest 100 samples of each type, kept by a stream."""
    return _newest_streamed(spark, sf, 100).read()


def stream_latency_by_type(spark, sf):
    """Percentiles of the newest 1,500 samples of each type, kept by a stream."""
    return latency_percentiles(_newest_streamed(spark, sf, 1500).read(), by=["event_type"], n=1500)


#: From, until: whole days, and a range that starts and ends within hours.
RANGES = (("2024-01-01 00:00:00", "2024-01-08 00:00:00"), ("2024-01-09 10:17:00", "2024-01-20 18:43:00"), ("2024-01-01 00:00:00", "2024-02-01 00:00:00"))


def latency_ranges(spark, sf):
    """Percentiles by type over ranges of time, out of cells that two batches have stored, one of them twice."""
    table = HistogramTable(spark, new_run_dir(spark, "cells"), ["event_type"])
    samples = E.latency_samples(spark, sf)
    for batch in (0, 1, 0):
        table.add(samples.filter(F.col("seq") % 2 == batch), "duration_ms", "ts", "samples", batch)
    table.fold(before="2024-01-16")
    wanted = {"p50": 50, "p95": 95, "p99": 99}
    told = [
        percentiles_of(table.cells(since, until), wanted, ["event_type"]).withColumn("since", F.lit(since))
        .withColumn("until", F.lit(until))
        for since, until in RANGES
    ]
    rounded = {name: F.round(name, 6) for name in wanted}
    return reduce(DataFrame.unionByName, told).withColumns(rounded)


def ledger_versions(spark, sf):
    """The ledger after a retry run that came twice, as entries and changes, folded between and after."""
    ledger = VersionedLedger(spark, new_run_dir(spark, "ledger-versions"), buckets=8)
    entries = E.ledger(spark, sf)
    ledger.add(entries.filter("id % 3 = 0"), "consumer", 0)
    ledger.fold()
    ledger.add(entries.filter("id % 3 <> 0"), "consumer", 1)
    for _ in range(2):
        ledger.apply(L.retry_run(ledger.current(), E.outcomes(spark, sf)), 0)
    ledger.fold()
    return ledger.current().drop("version")


def stream_message_counters(spark, sf):
    """Messages by (topic, status) as the sinks of a consumer told them, beside the consumer's own audit."""
    run = new_run_dir(spark, "measures")
    documents = E.raw_documents(spark, sf).select(F.col("value").cast("binary").alias("value"))
    append_to_topic(documents, f"{run}/topic")
    outputs = Outputs(
        timed(match_events_sink(f"{run}/table"), "match_events", f"{run}/measures"),
        audit=parquet_batches(f"{run}/audit"),
        quarantine=timed(parquet_batches(f"{run}/quarantine"), "unreadable", f"{run}/measures"),
    )
    _drained(start_consumer(read_topic_stream(spark, f"{run}/topic"), outputs, f"{run}/ckpt", available_now=True))
    told = message_counters(read_measures(spark, f"{run}/measures"))
    topic = F.when(F.col("outcome") == "success", "match_events").otherwise("unreadable")
    audit = spark.read.parquet(f"{run}/audit").groupBy(topic.alias("topic")).agg(F.sum("rows").alias("audited"))
    return told.join(audit, "topic").select("topic", "status", "messages", "audited")


def clustered_table(spark, sf):
    """match_events rewritten by date and match, all of it read back."""
    path = new_run_dir(spark, "clustered")
    write_clustered(storage_rows(E.valid_events(spark, sf)), path)
    return read_match_events(spark, path)


def topic_roundtrip(spark, sf):
    """Rows appended to a stored topic, read back."""
    path = new_run_dir(spark, "topic") + "/topic"
    append_to_topic(publish_rows(E.valid_events(spark, sf)), path)
    return storage_rows(decode_envelopes(read_topic(spark, path)).filter(~F.col("parse_error")))


def raw_text_errors(spark, sf):
    """Raw JSON text as a batch: written as lines, read back, checked."""
    path = new_run_dir(spark, "raw")
    E.raw_documents(spark, sf).select("value").write.text(path)
    return labelled_counts(validate(decode_documents(read_raw_events(spark, path))), "error_field", "error_message", name="documents")


def roster_scan(spark, sf):
    """The rosters of all teams as CSV files, read back team by team."""
    path = new_run_dir(spark, "roster")
    players = E.roster(spark, sf).select("team_id", "id", "name", F.upper("position").alias("position"))
    players.write.partitionBy("team_id").csv(path, header=True)
    teams = [read_roster(spark, f"{path}/team_id={team}", team) for team in TEAM_IDS]
    return reduce(DataFrame.unionByName, teams)


def ledger_scan(spark, sf):
    """A stored ledger read back oldest first, each entry with its place in that order."""
    path = new_run_dir(spark, "ledger")
    E.ledger(spark, sf).write.parquet(path)
    placed = L.with_place(read_ledger(spark, path))
    return placed.select("id", "retry_count", F.col("place").cast("int").alias("place"))


def null_rows_skipped(spark, sf):
    """Events of which every third is null: only the others are published."""
    rows = E.valid_events(spark, sf, "seq")
    nulled = rows.withColumn("event_id", F.when(F.col("seq") % 3 != 0, F.col("event_id")))
    return publish_rows(nulled).select(header_value(F.col("headers"), "event_id").cast("string").alias("event_id"))


def unknown_match(spark, sf):
    """Metrics of a match that has no events: no row."""
    return _flat(P.match_metrics(E.match_events(spark, sf), "match-of-nobody"))


def percentile_epoch(spark, sf):
    """Percentiles of times in epoch milliseconds: values that differ in their last digits only."""
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    rows = E.events(spark, sf).select("event_type", millis.alias("at"))
    return exact_percentiles(rows, "at", {"p50": 50, "p95": 95, "p99": 99}, by=["event_type"])


def metrics_json_with_latency(spark, sf):
    """The metrics document as every reader gets it, response percentiles included."""
    metrics = P.match_metrics(E.match_events(spark, sf))
    return P.metrics_json(P.with_latency(metrics, latency_percentiles(E.latency_samples(spark, sf))))


QUERIES = {
    "match_summary": match_summary,
    "match_summary_one": match_summary_one,
    "events_by_type": events_by_type,
    "events_by_type_one": events_by_type_one,
    "events_by_type_map": events_by_type_map,
    "events_per_minute": events_per_minute,
    "events_per_minute_one": events_per_minute_one,
    "minute_totals": minute_totals,
    "peak_minute": peak_minute,
    "match_activity": match_activity,
    "match_metrics": match_metrics,
    "match_metrics_one": match_metrics_one,
    "match_metrics_json": match_metrics_json,
    "match_metrics_with_latency": match_metrics_with_latency,
    "minute_rollup": minute_rollup,
    "rollup_equals_base": rollup_equals_base,
    "latency_percentiles": latency,
    "latency_percentiles_by_type": latency_by_type,
    "percentile_exact": percentile_exact,
    "percentile_exact_all": percentile_exact_all,
    "latest_n": latest_n,
    "latest_n_per_key": latest_n_per_key,
    "request_counters": request_counters,
    "request_counters_by_template": request_counters_by_template,
    "ingest_counters": ingest_counters,
    "error_rate": request_error_rate,
    "request_histogram": request_histogram,
    "query_histogram": query_histogram,
    "batch_histograms": batch_histograms,
    "message_size_histogram": message_size_histogram,
    "validate_first_error": validate_first_error,
    "validate_valid_rows": validate_valid_rows,
    "reject_counts": reject_counts,
    "error_text": error_texts,
    "storage_projection": storage_projection,
    "metadata_json": metadata_json,
    "envelope_encode": envelope_encode,
    "envelope_roundtrip": envelope_roundtrip,
    "envelope_decode_errors": envelope_decode_errors,
    "publish_rows": publish,
    "acceptance_receipt": acceptance_receipts,
    "retry_route": retry_route,
    "route_without_outputs": route_without_outputs,
    "retry_rows": retries,
    "retry_replay": replay,
    "dead_letter_rows": dead_letters,
    "batch_audit": audit,
    "consumer_lag": lag,
    "ledger_transition": ledger_transition,
    "ledger_summary": ledger_summary,
    "ledger_eligible": ledger_eligible,
    "ledger_append": ledger_append,
    "delivery_counts": delivery_counts,
    "quota_sample": stratified_sample,
    "roster_position": goalkeepers,
    "stream_ingest_counts": stream_ingest_counts,
    "stream_outcomes": stream_outcomes,
    "stream_minute_counts": stream_minute_counts,
    "stream_distinct": stream_distinct,
    "stream_two_writers": stream_two_writers,
    "stream_audit_counters": stream_audit_counters,
    "stream_distinct_committed": stream_distinct_committed,
    "stream_cell_deltas": stream_cell_deltas,
    "committed_repeat": committed_repeat,
    "compacted_dates": compacted_dates,
    "clustered_table": clustered_table,
    "topic_roundtrip": topic_roundtrip,
    "raw_text_errors": raw_text_errors,
    "roster_scan": roster_scan,
    "ledger_scan": ledger_scan,
    "ledger_versions": ledger_versions,
    "latency_ranges": latency_ranges,
    "stream_latest_n_per_key": stream_latest_n_per_key,
    "stream_latency_by_type": stream_latency_by_type,
    "stream_message_counters": stream_message_counters,
    "null_rows_skipped": null_rows_skipped,
    "unknown_match": unknown_match,
    "percentile_epoch": percentile_epoch,
    "match_metrics_json_with_latency": metrics_json_with_latency,
}


# The operators for training text live in a subpackage that may be absent.
try:
    from touchline.llm.queries import ORACLES as LLM_ORACLES
    from touchline.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    # The subpackage itself, or a library that only it needs.
    if (missing.name or "").startswith("touchline") and not missing.name.startswith("touchline.llm"):
        raise
    warnings.warn(f"the queries for training text are left out: {missing}", stacklevel=2)
    LLM_ORACLES, LLM_QUERIES = {}, {}


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _naive(query(configure(spark), sf_dir.rstrip("/")))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Full metrics row of every match."""
    return queries()["match_metrics"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _registered(query) for name, query in {**QUERIES, **LLM_QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **LLM_ORACLES}
