"""Hints to the optimizer that leave values unchanged."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that no later step computes again.

    Catalyst pushes a filter below a projection by copying what it filters on, which for a
    flag that rests on a parsed document copies the whole parse, once per reference.  Columns
    that come out of a generator are not copied: filters on them stay above it, and filters
    on columns that were there before pass it on their way to the scan.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def observed(seen: Observation, rows: DataFrame, **measures: Column) -> dict[str, int]:
    """What an action has observed of ``rows``, counted once more where it has told nothing.

    When nothing is left of the rows behind the observation, the plan may be cut short
    while it runs, and the observation with it.
    """
    try:
        found = seen.get
    except (Py4JError, AssertionError):
        found = {}
    return found or rows.agg(*[m.alias(name) for name, m in measures.items()]).first().asDict()
