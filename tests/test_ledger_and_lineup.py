"""Ledger transitions, roster scan and stratified samples."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.operators import ledger as L
from touchline.operators.lineup import quota_sample, with_position
from touchline.sources.tables import read_ledger, read_roster

T0 = dt.datetime(2024, 1, 1)


def ledger(spark, *retry_counts):
    rows = [(i, "{}", "Network error", T0 + dt.timedelta(hours=-i), n) for i, n in enumerate(retry_counts)]
    return spark.createDataFrame(
        rows, "id bigint, event_data string, failure_reason string, created_at timestamp, retry_count int"
    )


def outcomes(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, status_code int")


def test_transition(spark):
    run = L.retry_run(
        ledger(spark, 0, 0, 1, 2, 3, 5, 0),
        outcomes(spark, (0, 200), (1, 202), (2, 500), (3, None), (4, 200), (6, 503), (6, 200)),
    )
    assert {r["id"]: r["retry_count"] for r in L.ledger_after(run).collect()} == {2: 2, 3: 3, 4: 3, 5: 5}
    assert L.run_summary(run).first().asDict() == {"found": 7, "resent": 3, "still_failed": 4, "remaining": 4}


def test_success_codes_and_limit_are_parameters(spark):
    run = L.retry_run(ledger(spark, 0, 4), outcomes(spark, (0, 202), (1, 200)), max_retries=5, success_codes=(200,))
    assert {r["id"]: r["result"] for r in run.collect()} == {0: "failed", 1: "resent"}


def test_eligible_and_order(spark):
    df = ledger(spark, 0, 3, 2)
    assert {r["id"] for r in L.eligible(df).collect()} == {0, 2}
    assert [r["id"] for r in L.oldest_first(df).collect()] == [2, 1, 0]


def test_append(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger(spark, 0, 1).write.parquet(path)
    failures = spark.createDataFrame([("{}", None), ("{}", "HTTP 503: ")], "body string, reason string").repartition(2)
    first = L.next_id(read_ledger(spark, path))
    rows = L.new_entries(failures, F.col("body"), F.col("reason"), first)
    rows.write.mode("append").parquet(path)
    stored = read_ledger(spark, path).collect()
    assert len({r["id"] for r in stored}) == 4 and min(r["id"] for r in stored if r["id"] > 1) >= first
    assert sorted(r["failure_reason"] for r in stored) == ["HTTP 503: ", "Network error", "Network error", "Network error"]
    assert L.next_id(read_ledger(spark, path).filter("id < 0")) == 1


def test_delivery_counts(spark):
    df = spark.createDataFrame([("m", 200), ("m", 202), ("m", 500), ("m", None)], "match_id string, status_code int")
    assert tuple(L.delivery_counts(df, "match_id").first()) == ("m", 2, 2)


def players(spark, **counts):
    rows = [(team, f"{pos}{i}", pos) for team in (1, 2) for pos, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "team_id int, id string, position string")


STRATA = ["team_id", "position"]


def drawn(roster, quotas, seed):
    return sorted(map(tuple, quota_sample(roster, quotas, STRATA, "id", seed).collect()))


def test_sample_fills_each_quota(spark):
    roster = players(spark, gk=2, mid=8, fwd=5, **{"def": 700})
    quotas = spark.createDataFrame([(1, "gk", 2), (1, "def", 650), (2, "mid", 1), (2, "fwd", 0)], "team_id int, position string, quota int")
    rows = drawn(roster, quotas, 3)
    assert Counter((team, position) for team, _, position in rows) == {(1, "gk"): 2, (1, "def"): 650, (2, "mid"): 1}
    assert len(set(rows)) == len(rows)


def test_sample_is_repeatable_and_seeded(spark):
    roster = players(spark, mid=60)
    quotas = spark.createDataFrame([(1, "mid", 9)], "team_id int, position string, quota int")
    assert drawn(roster, quotas, 1) == drawn(roster.repartition(7), quotas, 1) != drawn(roster, quotas, 2)


def test_too_few_rows(spark):
    quotas = spark.createDataFrame([(1, "fwd", 1)], "team_id int, position string, quota int")
    with pytest.raises(ValueError, match="Not enough rows for 1, fwd"):
        quota_sample(players(spark, gk=1), quotas, STRATA, "id", 1)


def test_roster_scan(spark, tmp_path):
    path = tmp_path / "team.csv"
    path.write_text("id,name,position\n007,Ann Ó Example,GK\n8,Bob Example,Def\n", encoding="utf-8")
    rows = read_roster(spark, str(path), 2)
    assert {tuple(r) for r in rows.collect()} == {(2, "007", "Ann Ó Example", "gk"), (2, "8", "Bob Example", "def")}
    assert with_position(rows, "gk").count() == 1


def test_places_follow_the_order_across_ranges(spark):
    from touchline.operators.ledger import with_place

    rows = [(i, f"2024-01-{1 + (i * 7) % 5:02d} 00:00:00") for i in range(200)] + [(500, None)]
    ledger = spark.createDataFrame(rows, "id bigint, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    places = {r["id"]: r["place"] for r in with_place(ledger).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [places[r[0]] for r in want] == list(range(1, 202))
    assert with_place(ledger.limit(0)).collect() == []
