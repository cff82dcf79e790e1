"""Percentiles, newest-N, counters and histograms."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.operators.newest import newest
from touchline.operators import percentiles as P
from touchline.operators.percentiles import bucket_path, exact_percentiles, latency_percentiles, value_bucket
from touchline.operators.request_stats import error_rate, histogram, labelled_counts, path_template


def samples(spark, values, keys=None):
    rows = [(i, i // 2, keys[i] if keys else "k", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, ts bigint, key string, duration_ms double").repartition(4)


def expected(values, p):
    """The definition: linear interpolation at (p/100)*(n-1), two decimals, one value unrounded."""
    ordered = sorted(values)
    if len(ordered) == 1:
        return ordered[0]
    position = (p / 100) * (len(ordered) - 1)
    low, high = math.floor(position), math.ceil(position)
    value = ordered[low] + (position - low) * (ordered[high] - ordered[low])
    return math.floor(value * 100 + 0.5) / 100


def test_no_samples_give_no_row(spark):
    assert latency_percentiles(samples(spark, [1]).filter("seq > 5")).count() == 0


def test_single_sample(spark):
    assert tuple(latency_percentiles(samples(spark, [50])).first()) == (50, 50, 50)


def test_single_sample_is_not_rounded(spark):
    assert latency_percentiles(samples(spark, [1.23456]), whole_ms=False).first()["p50"] == 1.23456
    assert exact_percentiles(samples(spark, [1.23456]), "duration_ms", {"p": 50}).first()["p"] == 1.23456


def test_one_to_hundred(spark):
    assert tuple(latency_percentiles(samples(spark, range(1, 101))).first()) == (50.5, 95.05, 99.01)


def test_interpolation(spark):
    wanted = {"p25": 25, "p50": 50, "p75": 75}
    assert tuple(latency_percentiles(samples(spark, [10, 20, 30, 40, 50]), percentiles=wanted).first()) == (20, 30, 40)


def test_fractions_of_a_millisecond_are_dropped(spark):
    assert tuple(latency_percentiles(samples(spark, [1.9, 1.1])).first()) == (1, 1, 1)


def test_only_the_newest_count(spark):
    kept = newest(samples(spark, [10, 20, 30, 40, 50]), ["ts", "seq"], 3)
    assert sorted(r["duration_ms"] for r in kept.collect()) == [30, 40, 50]
    assert latency_percentiles(samples(spark, [10, 20, 30, 40, 50]), n=3).first()["p50"] == 40


def test_newest_per_key(spark):
    rng = random.Random(3)
    keys = ["hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}" for _ in range(2000)]
    kept = newest(samples(spark, range(2000), keys), ["ts", "seq"], 25, by=["key"])
    found = {}
    for row in kept.collect():
        found.setdefault(row["key"], []).append(row["seq"])
    for key in set(keys):
        assert sorted(found[key]) == sorted(i for i, k in enumerate(keys) if k == key)[-25:]


def test_percentiles_by_key_match_the_definition(spark):
    rng = random.Random(11)
    keys = ["hot" if i % 3 == 0 else f"k{i % 7}" for i in range(1500)]
    values = [round(rng.expovariate(0.05), 2) for _ in keys]
    df = samples(spark, values, keys)
    wanted = {"p0": 0, "p50": 50, "p95": 95, "p99": 99, "p100": 100}
    bounded = latency_percentiles(df, by=["key"], n=10_000, whole_ms=False, percentiles=wanted)
    exact = exact_percentiles(df, "duration_ms", wanted, by=["key"])
    for result in (bounded, exact):
        for row in result.collect():
            mine = [v for v, k in zip(values, keys) if k == row["key"]]
            for name, p in wanted.items():
                assert row[name] == pytest.approx(expected(mine, p), abs=1e-9)


def test_percentiles_keep_the_null_group_and_no_empty_one(spark):
    df = samples(spark, [1, 2, 3, 9], [None, None, None, "k"])
    found = exact_percentiles(df, "duration_ms", {"p": 50}, by=["key"])
    assert {tuple(r) for r in found.collect()} == {(None, 2.0), ("k", 9.0)}
    assert exact_percentiles(df.filter("seq > 9"), "duration_ms", {"p": 50}).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.integers(-3, 3).map(float), min_size=1, max_size=40))
def test_exact_percentiles_on_any_values(spark, values):
    row = exact_percentiles(samples(spark, values), "duration_ms", {"p50": 50, "p95": 95}).first()
    assert row["p50"] == pytest.approx(expected(values, 50), abs=0.011, rel=1e-12)
    assert row["p95"] == pytest.approx(expected(values, 95), abs=0.011, rel=1e-12)


def test_buckets_keep_the_order_of_values(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 2.0, 5e-324, -5e-324, 1e308, -1e308, 1e-305, float("inf"), float("-inf"), 0.5, 1023.9, 1024.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 12) for _ in range(500)]
    values += [math.nextafter(2.0**e, 0) for e in range(-20, 20)] + [2.0**e for e in range(-20, 20)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket(F.col("v")).alias("b"))
    buckets = [r["b"] for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_bucket_paths_tell_all_values_apart_in_order(spark):
    rng = random.Random(4)
    values = {1.7e12 + i for i in range(300)} | {math.nextafter(1.7e12, 2e12), -1.7e12, 0.0, 5e-324, 1e-310, 1e308, float("inf"), float("-inf")}
    values |= {rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 12) for _ in range(300)}
    values |= {math.nextafter(v, 0) for v in values if math.isfinite(v) and abs(v) > 1e-300}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    paths = [tuple(r)[1:] for r in df.select("v", *bucket_path(F.col("v"))).orderBy("v").collect()]
    assert paths == sorted(paths)
    ordinary = [p for p, v in zip(paths, sorted(values), strict=True) if v in (float("inf"), float("-inf")) or abs(v) > 1e-290 or v == 0]
    assert len(set(ordinary)) == len(ordinary)


def test_percentiles_of_close_values(spark):
    values = [1.7e12 + i for i in range(5000)]
    row = exact_percentiles(samples(spark, values), "duration_ms", {"p50": 50, "p99": 99}).first()
    assert (row["p50"], row["p99"]) == (expected(values, 50), expected(values, 99))


def test_newest_of_ties_and_short_tables(spark):
    df = spark.createDataFrame([(i, 7, float(i)) for i in range(50)], "seq bigint, ts bigint, v double")
    assert {r["seq"] for r in newest(df, ["ts", "seq"], 5).collect()} == {45, 46, 47, 48, 49}
    assert newest(df, ["ts", "seq"], 500).count() == 50 and newest(df.limit(0), ["ts"], 3).isEmpty()
    spread = spark.range(20_000).selectExpr("id as seq", "timestamp_seconds(id * id % 100003) as ts")
    wanted = {r["seq"] for r in spread.orderBy(F.desc("ts"), F.desc("seq")).limit(777).collect()}
    assert {r["seq"] for r in newest(spread, ["ts", "seq"], 777).collect()} == wanted


def test_newest_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i, "k", 1.0 * i) for i in range(10)], "seq bigint, ts bigint, k string, v double")
    for by in ([], ["k"]):
        kept = lambda n, by=by: {r["seq"] for r in newest(df, ["ts", "seq"], n, by).collect()}
        assert kept(10) == kept(12) == set(range(10))
        assert kept(7) == {0, 2, 4, 6, 8, 9, 7} and kept(5) == {0, 2, 4, 6, 8} and kept(2) == {6, 8}
        undated = df.withColumn("ts", F.lit(None).cast("timestamp"))
        assert {r["seq"] for r in newest(undated, ["ts", "seq"], 3, by).collect()} == {7, 8, 9}
    assert latency_percentiles(df, value="v", n=10).first()["p50"] == 4.5


def test_nan_is_no_measurement(spark):
    rows = histogram(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), "v", (2.0,)).collect()
    assert [(r["bucket_count"], r["value_count"], r["value_sum"]) for r in rows] == [(1, 1, 1.0)] * 2


def test_path_template(spark):
    df = spark.createDataFrame([("/api/matches/m-1/metrics",), ("/api/events",), ("/api/matches/m-2",)], "path string")
    found = [r[0] for r in df.select(path_template(F.col("path"))).collect()]
    assert found == ["/api/matches/{matchId}/metrics", "/api/events", "/api/matches/{matchId}"]


def test_counters_and_error_rate(spark):
    log = [("POST", 202)] * 6 + [("POST", 503)] * 2 + [("GET", 404)]
    df = spark.createDataFrame(log, "method string, status int")
    assert {tuple(r) for r in labelled_counts(df, "method", "status").collect()} == {
        ("POST", 202, 6),
        ("POST", 503, 2),
        ("GET", 404, 1),
    }
    assert {tuple(r) for r in error_rate(df, "method").collect()} == {("POST", 8, 2, 0.25), ("GET", 1, 0, 0.0)}


def test_histogram_is_cumulative_and_inclusive(spark):
    values = [0.005, 0.01, 0.02, 3.0, 99.0, None]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    rows = histogram(df, "v", (0.01, 1.0, 10.0), ["k"]).collect()
    assert [(r["le"], r["bucket_count"]) for r in rows] == [("0.01", 2), ("1.0", 3), ("10.0", 4), ("+Inf", 5)]
    assert {r["value_count"] for r in rows} == {5} and rows[0]["value_sum"] == pytest.approx(102.035)


def test_histogram_agrees_with_counting(spark):
    rng = random.Random(2)
    values = [rng.choice([1, 5, 10, 50, 200, 10001]) for _ in range(500)]
    rows = histogram(spark.createDataFrame([(v,) for v in values], "v int"), "v", (1, 10, 50, 100)).collect()
    counts = Counter(values)
    for row in rows[:-1]:
        assert row["bucket_count"] == sum(n for v, n in counts.items() if v <= int(row["le"]))


def skewed(spark):
    rng = random.Random(21)
    keys = ["hot" if i % 3 == 0 else f"k{i % 5}" for i in range(9000)]
    return keys, [round(rng.expovariate(0.05), rng.choice([0, 6])) for _ in keys]


def held(df, keys, values, wanted):
    for row in exact_percentiles(df, "duration_ms", wanted, by=["key"]).collect():
        mine = [v for v, k in zip(values, keys) if k == row["key"]]
        for name, p in wanted.items():
            assert row[name] == pytest.approx(expected(mine, p), abs=1e-9)


WANTED = {"p0": 0, "p25": 25, "p50": 50, "p99": 99, "p100": 100}


def test_sketched_percentiles_scan_twice_and_open_few_values(spark, monkeypatch):
    keys, values = skewed(spark)
    df = samples(spark, values, keys)
    made = {}
    stored = P._stored
    monkeypatch.setattr(P, "_stored", lambda rows, name: made.setdefault(name, stored(rows, name)))
    monkeypatch.setattr(P, "SMALL_GROUP", 0)
    held(df, keys, values, WANTED)
    # Two scans are all that reads the rows: what follows reads the stored counts.
    assert set(made) == {"brackets", "cells", "ranked"}
    assert made["cells"].count() < 0.2 * len(values)


@pytest.mark.parametrize(("ordered", "error"), [(0, 0.01), (0, 1e-9), (10**6, 1e-9)])
def test_many_values_and_missed_brackets_stay_exact(spark, monkeypatch, ordered, error):
    keys, values = skewed(spark)
    monkeypatch.setattr(P, "SMALL_GROUP", 0)
    monkeypatch.setattr(P, "ORDERED_VALUES", ordered)
    monkeypatch.setattr(P, "SKETCH_ERROR", error)
    held(samples(spark, values, keys), keys, values, WANTED)


def test_infinite_values_and_nan_have_their_ranks(spark):
    values = [float("-inf")] * 300 + [float(i) for i in range(1200)] + [float("inf")] * 400 + [float("nan")] * 101
    # 2,001 values: the ranks are 100, 1000, 1600 and 1980.
    row = exact_percentiles(samples(spark, values), "duration_ms", {"p5": 5, "p50": 50, "p80": 80, "p99": 99}).first()
    assert (row["p5"], row["p50"], row["p80"]) == (float("-inf"), 700.0, float("inf")) and math.isnan(row["p99"])
    only = exact_percentiles(samples(spark, [float("nan")] * 5), "duration_ms", {"p50": 50}).first()
    assert math.isnan(only["p50"])
