"""Micro-batch sinks: callables of (DataFrame, batch id) whose repeat leaves one copy of the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schema import MATCH_EVENTS
from touchline.sources.commits import MAX_BATCH_DATES, CommittedTable, within

BatchSink = Callable[[DataFrame, int], None]


def drop(rows: DataFrame, batch_id: int) -> None:
    """The choice to drop rows.  What is dropped is counted where it is handed over."""


def writer_of(rows: DataFrame, writer: str | None = None) -> str:
    """Who writes a batch: the given name, or the identity that a stream keeps in its checkpoint.

    Batch numbers start at 0 in every checkpoint, so a number alone does not name a batch.
    """
    name = writer or rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not name:
        raise ValueError("outside of a stream a sink needs the name of its writer")
    return name


def parquet_batches(path: str, *partition_by: str, writer: str | None = None) -> BatchSink:
    """Write each batch to a folder of its own, below that of its writer.

    A repeated batch replaces what an earlier try left; batches of other writers on the
    same path are never touched.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        frame_writer = rows.write.mode("overwrite")
        if partition_by:
            frame_writer = frame_writer.partitionBy(*partition_by)
        frame_writer.parquet(f"{path}/writer={writer_of(rows, writer)}/batch_id={batch_id}")

    return write


def match_events_sink(path: str, writer: str | None = None) -> BatchSink:
    """Batches of the match_events table, by date.

    Without the rebalance every task writes a file per date.  With it a date's rows meet
    first, and adaptive execution splits a date that is too large for one task.
    """
    write = parquet_batches(path, "event_date", writer=writer)
    return lambda rows, batch_id: write(rows.hint("rebalance", "event_date"), batch_id)


def distinct_match_events_sink(path: str, writer: str | None = None) -> BatchSink:
    """The same, leaving out events that are stored already, however late they come again.

    A repeat carries the time of its first copy, so it is looked for among the stored rows
    of the dates in the batch only.  Nothing is dropped for being late.  One writer at a
    time: two that store the same event at once do not see each other.
    """
    write = match_events_sink(path, writer)

    def write_new(rows: DataFrame, batch_id: int) -> None:
        # Kept for the search and the write, so that the batch is read and decoded once.
        rows = rows.persist()
        once = rows.dropDuplicates(["event_date", "event_id"])
        try:
            new, stored = once, _stored_ids(rows, path)
            if stored is not None:
                # What an earlier try of this very batch has left is about to be replaced.
                own = (F.col("writer") == writer_of(rows, writer)) & (F.col("batch_id") == batch_id)
                stored = within(_of_dates(stored.filter(~own), rows), rows, "event_id").select("event_date", "event_id")
                new = once.join(stored, ["event_date", "event_id"], "left_anti")
            write(new, batch_id)
        finally:
            rows.unpersist()

    return write_new


def committed_match_events(spark: SparkSession, path: str) -> CommittedTable:
    """The match_events table with a commit log."""
    return CommittedTable(spark, path, MATCH_EVENTS, id_column="event_id", cluster_by=("match_id", "timestamp"))


def committed_sink(path: str, writer: str | None = None, distinct: bool = False) -> BatchSink:
    """Batches of a match_events table whose readers see each batch whole or not at all, repeated ones included.

    ``distinct`` leaves out events stored already under their date; only files that may hold one are read.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        table = committed_match_events(rows.sparkSession, path)
        (table.append_new if distinct else table.append)(rows, writer_of(rows, writer), batch_id)

    return write


def _of_dates(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored rows of the dates of ``rows``; other dates' folders are not opened, as the plan names the dates."""
    dates = rows.select("event_date").distinct()
    named = [r["event_date"] for r in dates.limit(MAX_BATCH_DATES + 1).collect()]
    if len(named) > MAX_BATCH_DATES:
        return stored.join(dates, "event_date", "left_semi")
    return stored.filter(F.col("event_date").isin([d for d in named if d is not None]))


def _stored_ids(rows: DataFrame, path: str) -> DataFrame | None:
    schema = f"event_id string, event_date {MATCH_EVENTS['event_date'].dataType.simpleString()}, writer string, batch_id long"
    try:
        return rows.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def kafka_batches(servers: str) -> BatchSink:
    """Publish each batch to the topics named in its rows; a repeated batch is published again."""
    from touchline.sources.topics import write_to_kafka

    return lambda rows, batch_id: write_to_kafka(rows, servers)
