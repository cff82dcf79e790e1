"""Request decoding and first-error validation."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators.decode import decode_documents
from touchline.operators.validate import accepted, error_response, error_text, rejected, validate
from touchline.schema import EVENT_TYPES, FIELD_ERRORS, MALFORMED_MESSAGE

ID = "0b9c7d52-8e14-4f6a-9a33-51d2c7e0ab18"
GOOD = {
    "eventId": ID,
    "matchId": "derby/2031",
    "eventType": "corner",
    "timestamp": "2031-05-04T18:07:09Z",
    "teamId": 1,
    "playerId": "no-17",
    "metadata": {"side": "left", "tries": [2, 3]},
}
MISSING = object()


def changed(**fields):
    doc = {**GOOD, **fields}
    return json.dumps({k: v for k, v in doc.items() if v is not MISSING})


def check(spark, texts):
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")
    rows = validate(decode_documents(raw)).select("n", "error_field", "error_message").orderBy("n").collect()
    return [(r["error_field"], r["error_message"]) for r in rows]


# From the rules: an identifier is 32 hexadecimal digits in one of a few dresses.
BAD_FIELDS = {
    "eventId": [MISSING, None, "0", ID[:-1], ID + "0", ID.replace("b", "g"), ID.replace("-", "_"), ID[1:] + " ", "{" + ID, ID + "\n"],
    "matchId": [MISSING, None, ""],
    "eventType": [MISSING, None, "", "CORNER", "corner ", "corners", "half_time", "free-kick"],
    "timestamp": [
        MISSING,
        None,
        "",
        "yesterday",
        "1935943629",
        "2031-05-04",
        "18:07:09Z",
        "2031-05-04T18:07:09",
        "2031-05-04 18:07:09Z",
        "2031-05-04T18:07Z",
        "2031-13-04T18:07:09Z",
        "2031-02-29T18:07:09Z",
        "2031-05-04T24:00:00Z",
        "2031-05-04T18:60:09Z",
        "2031-05-04T18:07:60Z",
        "2031-05-04T18:07:09+0200",
        "2031-05-04T18:07:09+26:00",
        "2031-05-04t18:07:09z",
        "2031-05-04T18:07:09Z\n",
    ],
    "teamId": [MISSING, None, 0, -2, 12, 1 << 40],
}


@pytest.mark.parametrize("field", BAD_FIELDS)
def test_each_bad_field_is_named(spark, field):
    found = check(spark, [changed(**{field: value}) for value in BAD_FIELDS[field]])
    assert found == [(field, FIELD_ERRORS[field])] * len(found)


def test_valid_documents(spark):
    texts = [changed(eventType=t) for t in EVENT_TYPES]
    texts += [changed(teamId=t) for t in (1, 2)]
    texts += [changed(matchId=" "), changed(playerId=MISSING), changed(playerId=None), changed(extra=[1, {}])]
    texts += [changed(metadata=m) for m in (MISSING, None, {}, {"a": {"b": [1, "x", None]}})]
    texts += [changed() + " trailing", "  " + changed() + "{}"]
    assert check(spark, texts) == [(None, None)] * len(texts)


def test_malformed_documents(spark):
    texts = ["invalid json", "", "   ", changed()[:-1], "[" + changed() + "]", "5", '"text"', "true"]
    texts += [changed(teamId="1"), changed(teamId=1.0), changed(teamId=1.5), changed(teamId=10**20)]
    texts += [changed(matchId=5), changed(eventType=True), changed(timestamp={}), changed(eventId=[])]
    texts += [changed(playerId=7), changed(metadata="x"), changed(metadata=[]), changed(metadata=3)]
    assert check(spark, texts) == [(None, MALFORMED_MESSAGE)] * len(texts)


def test_missing_text_is_malformed(spark):
    raw = spark.createDataFrame([(None,)], "value string")
    assert validate(decode_documents(raw)).first()["error_message"] == MALFORMED_MESSAGE


def test_first_failing_check_wins(spark):
    texts = [
        changed(teamId=3, timestamp="x", eventType="x", matchId="", eventId="x"),
        changed(teamId=3, timestamp="x", eventType="x", matchId=""),
        changed(teamId=3, timestamp="x", eventType="x"),
        changed(teamId=3, timestamp="x"),
        changed(teamId=3),
        "null",
        "{}",
        changed(teamId="3", eventId="x"),
    ]
    fields = ["eventId", "matchId", "eventType", "timestamp", "teamId", "eventId", "eventId", None]
    assert [f for f, _ in check(spark, texts)] == fields


def test_random_documents_against_the_rules(spark):
    """Fields drawn from good, bad and wrongly typed values; expectations follow the written rules."""
    rng = random.Random(17)
    pools = {
        "eventId": [GOOD["eventId"]] * 6 + ["nope", 5, None, MISSING],
        "matchId": ["m"] * 6 + ["", 5, None, MISSING],
        "eventType": [GOOD["eventType"]] * 6 + ["GOAL", True, None, MISSING],
        "timestamp": [GOOD["timestamp"]] * 6 + ["2021-01-01", 1.5, None, MISSING],
        "teamId": [1, 2] * 3 + [0, 7, "1", 1.5, None, MISSING],
        "playerId": ["p"] * 6 + [5, [], None, MISSING],
        "metadata": [{}, {"a": [1]}] * 3 + ["x", [], 3, None, MISSING],
    }
    kinds = {"teamId": int, "metadata": dict}

    def expected(doc):
        for name, value in doc.items():
            if value is not None and value is not MISSING and type(value) is not kinds.get(name, str):
                return (None, MALFORMED_MESSAGE)
        for name in FIELD_ERRORS:
            wanted = (1, 2) if name == "teamId" else ("m",) if name == "matchId" else (GOOD[name],)
            if doc[name] not in wanted:
                return (name, FIELD_ERRORS[name])
        return (None, None)

    docs = [{name: rng.choice(pool) for name, pool in pools.items()} for _ in range(800)]
    found = check(spark, [changed(**doc) for doc in docs])
    assert found == [expected(doc) for doc in docs]
    assert len(set(found)) == 7


def test_last_duplicate_key_wins(spark):
    text = changed()[:-1] + ',"teamId":2,"matchId":"other"}'
    raw = spark.createDataFrame([(text,)], "value string")
    row = accepted(validate(decode_documents(raw))).first()
    assert (row["team_id"], row["match_id"]) == (2, "other")


@pytest.mark.parametrize(
    "text",
    [
        ID.upper(),
        "urn:uuid:" + ID,
        "Urn:Uuid:" + ID.title(),
        "{" + ID + "}",
        ID.replace("-", ""),
    ],
)
def test_uuid_forms_become_canonical(spark, text):
    raw = spark.createDataFrame([(changed(eventId=text),)], "value string")
    assert accepted(validate(decode_documents(raw))).first()["event_id"] == GOOD["eventId"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-15T14:30:00Z", "2024-01-15T14:30:00"),
        ("2024-01-15T14:30:00.5Z", "2024-01-15T14:30:00.500000"),
        ("2024-01-15T14:30:00.123456789Z", "2024-01-15T14:30:00.123456"),
        ("2024-01-15T14:30:00+03:00", "2024-01-15T11:30:00"),
        ("2024-01-15T14:30:00.25-05:30", "2024-01-15T20:00:00.250000"),
        ("2024-01-15T14:30:00+23:59", "2024-01-14T14:31:00"),
        ("2024-02-29T00:00:00-00:00", "2024-02-29T00:00:00"),
    ],
)
def test_timestamps(spark, text, expected):
    raw = spark.createDataFrame([(changed(timestamp=text),)], "value string")
    rows = accepted(validate(decode_documents(raw))).select(F.col("timestamp").cast("timestamp_ntz"))
    assert rows.first()[0] == dt.datetime.fromisoformat(expected)


def test_split_keeps_every_row_once(spark):
    texts = [changed(), changed(teamId=9), "nope", changed(eventType="pass")]
    validated = validate(decode_documents(spark.createDataFrame([(t,) for t in texts], "value string")))
    assert accepted(validated).count() == 2
    assert {r["value"] for r in rejected(validated).collect()} == {texts[1], texts[2]}


def test_type_list_is_a_parameter(spark):
    raw = spark.createDataFrame([(changed(eventType="match_start"),)], "value string")
    assert accepted(validate(decode_documents(raw), [*EVENT_TYPES, "match_start"])).count() == 1


def test_error_texts(spark):
    row = spark.range(1).select(
        error_text(F.lit("fieldName"), F.lit("error message")).alias("text"),
        error_response(F.lit("teamId"), F.lit("must be 1 or 2")).alias("with_field"),
        error_response(F.lit(None).cast("string"), F.lit(MALFORMED_MESSAGE)).alias("without"),
    ).first()
    assert row["text"] == "validation error: field 'fieldName' error message"
    assert json.loads(row["with_field"]) == {"error": "Bad Request", "message": "must be 1 or 2", "field": "teamId"}
    assert json.loads(row["without"]) == {"error": "Bad Request", "message": MALFORMED_MESSAGE}
