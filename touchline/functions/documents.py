"""Strictly typed access to JSON documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_mark(text: Column) -> Column:
    """VARIANT of a two-element array: the document, and behind it the text's own hash.

    ``try_parse_json`` stops after the first value and ignores the rest.  In the array,
    anything after the document breaks the array, closes it early, or takes the hash's
    place, so :func:`document_alone` can tell.
    """
    mark = F.xxhash64(text).cast("string")
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")))


def document_alone(marked: Column, text: Column) -> Column:
    """The document of a :func:`with_mark` array, NULL when other text followed it."""
    intact = F.try_variant_get(marked, "$[1]", "long") == F.xxhash64(text)
    return F.when(intact, F.try_variant_get(marked, "$[0]", "variant"))


def fields_of(document: Column, *names: str) -> Column:
    """STRUCT of the named top-level fields, each still a VARIANT and NULL when missing.

    NULL when the document is not an object.  One walk over the document serves all fields.
    """
    shape = ", ".join(f"{name}: variant" for name in names)
    return F.try_variant_get(document, "$", f"struct<{shape}>")


def has_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT field is of a JSON type, null, or missing."""
    found = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return (found == "VOID") | found.startswith(kind)


def scalar(value: Column, as_type: str) -> Column:
    return F.try_variant_get(value, "$", as_type)


def object_json(value: Column) -> Column:
    """JSON text of an object VARIANT; missing, null and empty objects all give ``{}``."""
    return F.coalesce(F.nullif(F.to_json(value), F.lit("null")), F.lit("{}"))
