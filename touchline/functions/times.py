"""RFC 3339 text and minute bucketing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))\z"


def parse_rfc3339(text: Column) -> Column:
    """Instant named by RFC 3339 text, NULL when the text has another shape or no such date exists.

    The zone is mandatory.  The offset is applied by arithmetic because Spark's own cast
    stops at 18 hours.  Digits below the microsecond are dropped.
    """
    in_utc = text.endswith("Z")
    # The wall-clock part read as if it were UTC; then shifted when an offset follows it.
    wall = F.when(in_utc, text).otherwise(F.concat(F.left(text, F.length(text) - 6), F.lit("Z")))
    wall = wall.try_cast("timestamp")
    sign = F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1)
    minutes = F.substring(text, -5, 2).try_cast("long") * 60 + F.substring(text, -2, 2).try_cast("long")
    shifted = F.timestamp_micros(F.unix_micros(wall) - sign * minutes * 60_000_000)
    return F.when(text.rlike(_SHAPE), F.when(in_utc, wall).otherwise(shifted))


def format_rfc3339(instant: Column) -> Column:
    """UTC RFC 3339 text with the fraction's trailing zeros (or the whole fraction) removed."""
    text = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*\z", ""), F.lit("Z"))


def minute_of(instant: Column) -> Column:
    """Start of the minute the instant falls in."""
    return F.date_trunc("minute", instant)
