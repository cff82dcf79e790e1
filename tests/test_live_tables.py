"""Additive histogram cells, the newest rows of a stream, the ledger as versions, and measures of running streams."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

import table_inputs as E
from touchline.operators import ledger as L
from touchline.operators.log_histogram import ERROR, HistogramTable, growth, histogram_cells, percentiles_of
from touchline.operators.newest import newest
from touchline.sources.commits import CommittedTable
from touchline.sources.ledger_versions import VersionedLedger
from touchline.streaming.measures import (
    ProgressRows,
    message_counters,
    read_measures,
    read_progress,
    timed,
    write_seconds,
)
from touchline.streaming.newest import NewestTable, start_newest
from touchline.streaming.sinks import parquet_batches

SF = "/root/testdata/sf0.001"


def as_list(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# -- histogram cells


def samples(spark, count=4000):
    rng = random.Random(3)
    odd = [0.0, -0.0, None, math.nan, math.inf, -math.inf, 5e-324, 1.7e308, -1e-9]
    values = odd + [rng.choice((-1, 1, 1)) * 10 ** rng.uniform(-4, 6) for _ in range(count)]
    rows = [(i, f"2024-03-0{1 + i % 3} 10:{i % 60:02d}:30", "abc"[i % 3 == 0], v) for i, v in enumerate(values)]
    rows.append((count + 10, None, "a", 1.0))
    return spark.createDataFrame(rows, "i long, at string, kind string, v double").withColumn("at", F.col("at").cast("timestamp"))


def within(found, exact, error):
    if math.isnan(found) or math.isinf(found):
        return False
    # The least positive double has no neighbour within one percent.
    return abs(found - exact) <= error * abs(exact) * (1 + 1e-9) + 5e-324


@pytest.mark.parametrize("error", [ERROR, 0.1])
def test_percentiles_of_any_range_keep_the_error(spark, tmp_path, error):
    rows = samples(spark)
    table = HistogramTable(spark, f"{tmp_path}/cells", ["kind"], error)
    for batch in (0, 1, 2, 1, 0):
        table.add(rows.filter(F.col("i") % 3 == batch), "v", "at", "one", batch)
    wanted = {"low": 0, "p10": 10, "p50": 50, "p95": 95, "high": 99.9}
    held = [r.asDict() for r in rows.collect() if r["at"] and r["v"] is not None and math.isfinite(r["v"])]
    ranges = [("2024-03-01 10:07:00", "2024-03-01 10:31:00"), ("2024-03-01 10:30:00", "2024-03-03 10:30:00"), ("2024-03-01 00:00:00", "2024-04-01 00:00:00")]
    for folded in (False, True):
        for since, until in ranges:
            inside = [r for r in held if since <= str(r["at"]) < until]
            for by in ([], ["kind"]):
                got = percentiles_of(table.cells(since, until), wanted, by, error).collect()
                groups = {}
                for r in inside:
                    groups.setdefault(tuple(r[k] for k in by), []).append(r["v"])
                assert {tuple(r[k] for k in by): r["n"] for r in got} == {k: len(v) for k, v in groups.items()}
                for r in got:
                    values = sorted(groups[tuple(r[k] for k in by)])
                    for name, p in wanted.items():
                        assert within(r[name], values[math.floor(p / 100 * (len(values) - 1))], error), (name, r)
        if not folded:
            table.fold()
    assert percentiles_of(table.cells("2025-01-01 00:00:00", "2026-01-01 00:00:00"), wanted, ["kind"], error).isEmpty()


def test_cells_do_not_grow_with_the_rows(spark):
    rows = samples(spark, 500)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    assert histogram_cells(many, "v", "at").count() == histogram_cells(rows, "v", "at").count()
    with pytest.raises(ValueError):
        growth(1.0)


# -- newest rows


def test_newest_rows_of_a_stream_stay_few_and_late_rows_count(spark, tmp_path):
    rows = E.latency_samples(spark, SF).cache()
    parts = 6
    for part in range(parts):
        # The newest rows come first and the oldest last, with some of all times in each.
        turn = F.least(F.floor((F.lit(30) - F.dayofmonth("ts")) / 5), F.lit(parts - 1))
        chosen = F.when(F.col("seq") % 4 == 0, F.col("seq") % parts).otherwise(turn) == part
        rows.filter(chosen).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table = NewestTable(spark, f"{tmp_path}/newest", rows.schema, ["ts", "seq"], ["event_type"], n=20, buckets=3)
    start_newest(stream, table, f"{tmp_path}/ckpt", fold_every=2, available_now=True).awaitTermination()
    want = newest(rows, ["ts", "seq"], 20, ["event_type"])
    assert as_list(table.read()) == as_list(want)
    table.fold()
    keys = rows.select("event_type").distinct().count()
    assert table.stored_rows() == want.count() <= 20 * keys and as_list(table.read()) == as_list(want)


def test_a_repeated_batch_and_rows_without_keys(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, None if i == 4 else i * 10) for i in range(10)], "id long, k long, at long")
    table = NewestTable(spark, f"{tmp_path}/one", rows.schema, ["at", "id"], n=3)
    for batch in (0, 1, 0, 1):
        table.add(rows.filter(F.col("k") == batch), "w", batch)
    assert table.stored_rows() == 6
    table.fold()
    assert table.stored_rows() == 3 and sorted(r["id"] for r in table.read().collect()) == [7, 8, 9]
    few = NewestTable(spark, f"{tmp_path}/few", rows.schema, ["at", "id"], ["k"], n=50)
    assert few.read().isEmpty()
    few.add(rows, "w", 0)
    assert as_list(few.read()) == as_list(rows)


# -- the ledger as versions


def two_runs(spark, entries, answers):
    after = L.ledger_after(L.retry_run(entries, answers))
    return L.ledger_after(L.retry_run(after, answers.withColumn("status_code", F.lit(500))))


def test_runs_over_versions_equal_rewrites_and_repeat_safely(spark, tmp_path, monkeypatch):
    entries, answers = E.ledger(spark, SF), E.outcomes(spark, SF)
    ledger = VersionedLedger(spark, f"{tmp_path}/ledger", buckets=3)
    assert ledger.current().isEmpty()
    for batch in (0, 1, 0):
        ledger.add(entries.filter(F.col("id") % 2 == batch), "consumer", batch)
    assert as_list(ledger.current().drop("version")) == as_list(entries)

    publish = CommittedTable._publish
    monkeypatch.setattr(CommittedTable, "_publish", lambda self, change: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.apply(L.retry_run(ledger.current(), answers), 0)
    assert as_list(ledger.current().drop("version")) == as_list(entries)
    monkeypatch.setattr(CommittedTable, "_publish", publish)

    for _ in range(3):
        ledger.apply(L.retry_run(ledger.current(), answers), 0)
    once = L.retry_run(entries, answers)
    assert as_list(ledger.current().drop("version")) == as_list(L.ledger_after(once))
    assert ledger.history().count() == once.filter(F.col("result") != L.SKIPPED).count()
    held = ledger.current()
    ledger.fold()
    # A reader that planned before the fold keeps its files, one that plans after it sees the same entries.
    assert as_list(held.drop("version")) == as_list(ledger.current().drop("version"))
    assert ledger.history().isEmpty() and as_list(held) == as_list(ledger.current())
    assert ledger.table.read().count() == ledger.current().count()
    ledger.apply(L.retry_run(ledger.current(), answers.withColumn("status_code", F.lit(500))), 1)
    assert as_list(ledger.current().drop("version")) == as_list(two_runs(spark, entries, answers))
    more = entries.limit(2).withColumn("id", F.col("id") + 10_000_000)
    ledger.add(more, "consumer", 2)
    ledger.fold()
    assert as_list(ledger.current().drop("version")) == as_list(two_runs(spark, entries, answers).union(more))


# -- measures


def test_failures_and_successes_are_rows_of_their_own(spark, tmp_path):
    rows, path = spark.range(30), f"{tmp_path}/measures"
    broken = {1}

    def store(batch, batch_id):
        if batch_id in broken:
            raise ConnectionError("store is down")
        parquet_batches(f"{tmp_path}/table", writer="w")(batch, batch_id)

    sink = timed(store, "events", path, writer="w")
    sink(rows, 0)
    sink(rows, 0)
    with pytest.raises(ConnectionError):
        sink(rows.limit(7), 1)
    broken.clear()
    sink(rows.limit(7), 1)
    sink(rows.limit(0), 2)
    timed(parquet_batches(f"{tmp_path}/dead", writer="w"), "dead", path, writer="w")(rows.limit(2), 0)
    measures = read_measures(spark, path)
    got = {(r["topic"], r["status"]): (r["batches"], r["messages"]) for r in message_counters(measures).collect()}
    assert got == {("events", "success"): (3, 37), ("events", "error"): (1, 7), ("dead", "success"): (1, 2)}
    assert measures.filter("duration_s <= 0").isEmpty()
    seconds = write_seconds(measures).filter("le = '+Inf'").collect()
    assert {r["topic"]: r["bucket_count"] for r in seconds} == {"events": 4, "dead": 1}


def test_progress_is_kept_as_rows(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 5 + part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    listener = ProgressRows(spark, f"{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = (
            stream.writeStream.option("checkpointLocation", f"{tmp_path}/ckpt")
            .foreachBatch(parquet_batches(f"{tmp_path}/out"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        until = time.monotonic() + 20
        while time.monotonic() < until:
            mine = read_progress(spark, f"{tmp_path}/progress").filter(F.col("query_id") == query.id)
            if (mine.agg(F.sum("rows")).first()[0] or 0) >= 18:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    told = sorted((r["batch_id"], r["rows"]) for r in mine.filter("rows > 0").collect())
    assert [b for b, _ in told] == [0, 1, 2] and sorted(n for _, n in told) == [5, 6, 7]
    assert mine.filter("rows > 0 and (duration_s <= 0 or lag <> 0)").isEmpty()
