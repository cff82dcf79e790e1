"""Typed decoding of JSON events: request bodies and topic envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import documents as D
from touchline.functions.identifiers import canonical_uuid
from touchline.functions.plans import computed_once
from touchline.functions.times import parse_rfc3339

# Wire fields and the JSON type each must have.
FIELD_KINDS = {
    "eventId": "STRING",
    "matchId": "STRING",
    "eventType": "STRING",
    "timestamp": "STRING",
    "teamId": "BIGINT",
    "playerId": "STRING",
    "metadata": "OBJECT",
}


def decode_documents(raw: DataFrame, column: str = "value", strict_trailing: bool = False) -> DataFrame:
    """Add the typed wire fields to a DataFrame of JSON text.

    Text after the first JSON value is ignored unless ``strict_trailing`` is set.
    ``malformed`` is true when the text is not JSON, is neither an object nor null, or has
    a field of the wrong JSON type; all typed fields are then NULL.  Missing and null
    fields take their zero value ('' or 0).  Unknown keys are ignored.
    """
    text, doc = F.col(column).cast("string"), F.col("_document")
    if strict_trailing:
        parsed = computed_once(raw, _marked=D.with_mark(text))
        parsed = computed_once(parsed, _document=D.document_alone(F.col("_marked"), text)).drop("_marked")
    else:
        parsed = computed_once(raw, _document=F.try_parse_json(text))
    split = computed_once(parsed, _fields=D.fields_of(doc, *FIELD_KINDS))

    well_typed = F.lit(True)
    for name, kind in FIELD_KINDS.items():
        well_typed = well_typed & D.has_kind(F.col(f"_fields.{name}"), kind)
    # A lone null is a document without fields.
    usable = F.when(F.col("_fields").isNotNull(), well_typed).otherwise(F.coalesce(F.is_variant_null(doc), F.lit(False)))
    checked = computed_once(split, malformed=~usable)
    good = ~F.col("malformed")

    def value(name: str, as_type: str, missing) -> Column:
        return F.when(good, F.coalesce(D.scalar(F.col(f"_fields.{name}"), as_type), F.lit(missing)))

    metadata = F.col("_fields.metadata")
    return checked.withColumns(
        {
            "raw_event_id": value("eventId", "string", ""),
            "match_id": value("matchId", "string", ""),
            "event_type": value("eventType", "string", ""),
            "raw_timestamp": value("timestamp", "string", ""),
            "team_id": value("teamId", "long", 0),
            "player_id": value("playerId", "string", ""),
            "metadata": F.when(good & ~F.is_variant_null(metadata), metadata),
        }
    ).drop("_document", "_fields")


def decode_envelopes(topic: DataFrame, column: str = "value") -> DataFrame:
    """Decode topic envelopes; only JSON shape, UUID and timestamp are checked here.

    Adds the VALID_EVENT columns and ``parse_error``.  Match, type and team were checked
    on the way in and are taken as they are.  A topic row's own ``timestamp`` column is
    the record time and is replaced by the event's.
    """
    kept = [c for c in topic.columns if c != "timestamp"]
    decoded = decode_documents(topic.select(*kept), column, strict_trailing=True)
    checked = computed_once(
        decoded, event_id=canonical_uuid(F.col("raw_event_id")), timestamp=parse_rfc3339(F.col("raw_timestamp"))
    )
    unusable = F.col("event_id").isNull() | F.col("timestamp").isNull()
    return checked.withColumn("parse_error", unusable).drop("malformed", "raw_event_id", "raw_timestamp")
