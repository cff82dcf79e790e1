"""First-error validation of decoded requests, and the accept / reject split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.identifiers import canonical_uuid
from touchline.functions.plans import computed_once
from touchline.functions.times import parse_rfc3339
from touchline.schema import EVENT_TYPES, FIELD_ERRORS, MALFORMED_MESSAGE, TEAM_IDS

VALID_EVENT = ("event_id", "match_id", "event_type", "timestamp", "team_id", "player_id", "metadata")


def validate(decoded: DataFrame, event_types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """Add ``event_id``, ``timestamp``, ``error_field`` and ``error_message``.

    The first failing check names the error; accepted rows have a NULL ``error_message``.
    Malformed documents have a message but no field.
    """
    typed = computed_once(
        decoded, event_id=canonical_uuid(F.col("raw_event_id")), timestamp=parse_rfc3339(F.col("raw_timestamp"))
    )
    # In the order of FIELD_ERRORS: the position of a failure decides which one is told.
    failures = {
        "eventId": F.col("event_id").isNull(),
        "matchId": F.col("match_id") == "",
        "eventType": ~F.col("event_type").isin(*event_types),
        "timestamp": F.col("timestamp").isNull(),
        "teamId": ~F.col("team_id").isin(*TEAM_IDS),
    }
    error_field = F.when(F.col("malformed"), F.lit(None).cast("string"))
    error_message = F.when(F.col("malformed"), F.lit(MALFORMED_MESSAGE))
    for name, message in FIELD_ERRORS.items():
        error_field = error_field.when(failures[name], F.lit(name))
        error_message = error_message.when(failures[name], F.lit(message))
    return typed.withColumns({"error_field": error_field, "error_message": error_message})


def accepted(validated: DataFrame, *keep: str) -> DataFrame:
    """VALID_EVENT rows, plus any ``keep`` columns."""
    rows = validated.filter(F.col("error_message").isNull())
    return rows.select(*keep, *[F.col(c).cast("int") if c == "team_id" else F.col(c) for c in VALID_EVENT])


def rejected(validated: DataFrame, *keep: str, column: str = "value") -> DataFrame:
    """Raw text of rejected rows with the error's field and message, plus any ``keep`` columns."""
    rows = validated.filter(F.col("error_message").isNotNull())
    return rows.select(*keep, column, "error_field", "error_message")


def error_text(field: Column, message: Column) -> Column:
    """Log form of a field error."""
    return F.format_string("validation error: field '%s' %s", field, message)


def error_response(field: Column, message: Column, status_text: str = "Bad Request") -> Column:
    """JSON body of a rejection; ``field`` is left out where there is none."""
    return F.to_json(
        F.struct(F.lit(status_text).alias("error"), message.alias("message"), F.nullif(field, F.lit("")).alias("field"))
    )
