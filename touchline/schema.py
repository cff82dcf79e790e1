"""Fixed values and table schemas of the match-event model."""

from __future__ import annotations

from pyspark.sql import types as T

# The event types an ingested event may carry (case-sensitive).
EVENT_TYPES = (
    "pass",
    "shot",
    "goal",
    "foul",
    "yellow_card",
    "red_card",
    "substitution",
    "offside",
    "corner",
    "free_kick",
    "interception",
)

# The team identifiers an ingested event may carry.
TEAM_IDS = (1, 2)

# Validation messages, by wire field, in the order the checks run.
FIELD_ERRORS = {
    "eventId": "must be a valid UUID",
    "matchId": "is required",
    "eventType": "must be a valid event type",
    "timestamp": "must be a valid RFC3339 timestamp",
    "teamId": "must be 1 or 2",
}
MALFORMED_MESSAGE = "invalid JSON body"

# Delivery rules.
MAX_RETRIES = 3
DEAD_LETTER_REASON = "max_retries_exceeded_or_permanent_failure"
SUCCESS_CODES = (200, 202)
DEFAULT_FAILURE_REASON = "Network error"
LATENCY_WINDOW = 10_000
BATCH_ROWS = 1000
BATCH_INTERVAL = "5 seconds"

# Histogram bucket bounds (seconds, rows or bytes).
REQUEST_SECONDS_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUERY_SECONDS_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
CONSUME_SECONDS_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BATCH_ROWS_BUCKETS = (1, 10, 50, 100, 500, 1000, 5000, 10000)
MESSAGE_BYTES_BUCKETS = (100, 500, 1000, 5000, 10000, 50000, 100000)

MATCH_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("match_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("player_id", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

TOPIC_HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

# Row shape of a topic, the same as the Kafka source with headers included.
TOPIC = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", TOPIC_HEADERS),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_data", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("retry_count", T.IntegerType()),
    ]
)

ROSTER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("position", T.StringType()),
    ]
)

