"""Physical plans: scans, shuffles, pushed filters, and no Python in the hot path."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import table_inputs as E
from touchline.operators import match_counts as M
from touchline.operators.decode import decode_documents, decode_envelopes
from touchline.operators.encode import publish_rows, storage_rows
from touchline.operators.lineup import quota_sample
from touchline.operators.newest import newest
from touchline.operators.percentiles import exact_percentiles
from touchline.operators.validate import accepted, validate
from touchline.plans import match_metrics as P
from touchline.sources.tables import read_match_events, write_clustered

SF = "/root/testdata/sf0.001"
STREAMED = [n for n in entry.QUERIES if n.startswith("stream_")]
OWN = list(entry.QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "match_events")
    write_clustered(storage_rows(E.valid_events(spark, SF)), path)
    return read_match_events(spark, path)


def test_metrics_of_all_matches_scan_once(table):
    text = plan(P.match_metrics(table))
    assert count("FileScan", text) == 1
    assert count("Exchange hashpartitioning", text) == 2
    assert "Join" not in text and "Window" not in text and "Sort" not in text
    assert count("partial_count", text) >= 1
    assert "ReadSchema: struct<match_id:string,event_type:string,timestamp:timestamp>" in text


def test_peak_is_hash_aggregated(table):
    text = plan(M.peak_minute(table))
    assert "SortAggregate" not in text and "Sort " not in text
    assert count("FileScan", text) == 1 and count("Exchange hashpartitioning", text) == 2


def test_one_match_is_pushed_to_the_scan(table):
    for df in (P.match_metrics(table, "m-1"), M.match_summary(table, "m-1"), M.events_per_minute(table, "m-1")):
        assert "PushedFilters: [IsNotNull(match_id), EqualTo(match_id,m-1)]" in plan(df)


def test_dates_prune_partitions(spark, tmp_path):
    write_clustered(storage_rows(E.valid_events(spark, SF)), f"{tmp_path}/t")
    text = plan(read_match_events(spark, f"{tmp_path}/t", "2024-01-05", "2024-01-06"))
    assert count(r"PartitionFilters: \[[^\]]*event_date", text) == 1


def test_latency_is_attached_without_a_join(spark, table):
    text = plan(P.with_latency(P.match_metrics(table), spark.sql("select 1d p50, 2d p95, 3d p99")))
    assert "Join" not in text and "CartesianProduct" not in text


def test_newest_pushes_its_cut_off_to_the_scan(spark):
    samples = E.latency_samples(spark, SF)
    text = plan(newest(samples, ["ts", "seq"], 100))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)
    assert "TakeOrderedAndProject" in text and "Window" not in text
    by_key = plan(newest(samples, ["ts", "seq"], 100, by=["event_type"]))
    assert "WindowGroupLimit" in by_key.split("Exchange")[-1]


def test_exact_percentiles_collect_nothing(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("rows reach the driver while the plan is made")

    samples = E.latency_samples(spark, SF)
    for name in ("collect", "first", "head", "toPandas", "toArrow", "take"):
        monkeypatch.setattr(type(samples), name, fail)
    text = plan(exact_percentiles(samples, "duration_ms", {"p50": 50}, ["event_type"]))
    assert "collect_list" not in text and "percentile(" not in text


def test_sample_trims_strata_before_shuffling(spark):
    players = E.roster(spark, SF)
    quotas = spark.createDataFrame([(1, "gk", 1)], "team_id int, position string, quota int")
    assert plan(quota_sample(players, quotas, ["team_id", "position"], "id", 1)).count("Window ") == 2


def test_documents_are_parsed_once(spark, tmp_path):
    E.raw_documents(spark, SF).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    good = accepted(validate(decode_documents(raw)))
    events = decode_envelopes(raw).filter(~F.col("parse_error"))
    for df in (good, publish_rows(good), storage_rows(events)):
        text = plan(df)
        assert count(r"(?i)parseJson", text) == 1
        assert "Exchange" not in text


def test_source_filters_pass_the_parse(spark, tmp_path):
    E.raw_documents(spark, SF).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    for rows in (decode_documents(raw), validate(decode_documents(raw)), decode_envelopes(raw)):
        assert "EqualTo(doc_id,5)" in plan(rows.filter("doc_id = 5"))


@pytest.mark.parametrize("name", [n for n in OWN if n not in STREAMED])
def test_no_python_and_no_all_pairs(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "InArrow"):
        assert operator not in text
