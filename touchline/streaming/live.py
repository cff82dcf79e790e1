"""Minute counts kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.plans.match_metrics import merge_cells, minute_cells
from touchline.sources.commits import CommittedTable
from touchline.streaming.sinks import parquet_batches, writer_of


def live_minute_cells(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running roll-up of a stream of events.

    Without a watermark every late event is counted, as in the batch queries, and state
    grows by one small row per match, minute and type.  A watermark bounds the state but
    drops events that come later than it allows; their number is in the query's progress.
    """
    if watermark is None:
        return minute_cells(events)
    # State is only cleared when the grouping is a window over the watermarked column.
    return minute_cells(events.withWatermark("timestamp", watermark), F.window("timestamp", "1 minute")).withColumn(
        "minute", F.col("minute.start")
    )


def start_live_cells(cells: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the cells each batch changed; :func:`latest_cells` reads them back."""
    writer = (
        cells.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(parquet_batches(path))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_cells(versions: DataFrame) -> DataFrame:
    """Newest version of every cell.

    Counts and last times only grow and first times only shrink, so no ordering of the
    versions is needed and the aggregation combines before its shuffle.
    """
    return versions.groupBy("match_id", "minute", "event_type").agg(
        F.max("event_count").alias("event_count"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
    )


CELL_DELTAS = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("minute", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("first_event_at", T.TimestampType()),
        T.StructField("last_event_at", T.TimestampType()),
        T.StructField("cell_date", T.DateType()),
    ]
)


def cell_deltas(spark: SparkSession, path: str) -> CommittedTable:
    """Additive changes of minute cells, by the date of the minute."""
    return CommittedTable(spark, path, CELL_DELTAS, date_column="cell_date", cluster_by=("match_id", "minute"))


def start_cell_deltas(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Live minute counts without state: each batch stores what it adds to its cells, however late its events are.

    Nothing is kept between batches and nothing is dropped; a repeated batch is stored once. :func:`counted_cells` adds up
    the changes, and :func:`fold_deltas` keeps their number down.
    """

    def add(rows: DataFrame, batch_id: int) -> None:
        cells = minute_cells(rows).withColumn("cell_date", F.to_date("minute"))
        cell_deltas(rows.sparkSession, path).append(cells, writer_of(rows), batch_id)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counted_cells(spark: SparkSession, path: str, first_date: str | None = None, last_date: str | None = None) -> DataFrame:
    """The cells as all batches have left them; a date range opens the changes of these dates only."""
    return merge_cells(cell_deltas(spark, path).read(first_date, last_date).drop("cell_date"))


def fold_deltas(spark: SparkSession, path: str, before: str | None = None) -> None:
    """Adds up the changes of each date, while batches go on."""
    cell_deltas(spark, path).compact(before, lambda rows: merge_cells(rows.drop("cell_date")).withColumn("cell_date", F.to_date("minute")))
