"""Measures of running streams, as rows: batches and messages by (topic, status), write times, progress and lag.

:func:`timed` wraps any batch sink and writes one row for each batch that it stores or fails to store. Rows are counted on their way into
the sink, without a job of their own. :class:`ProgressRows` is a listener that writes one row for each micro-batch of all
streams of a session. Both are read back as tables, so that counters, rates and histograms are queries like others.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from touchline.functions.plans import observed
from touchline.operators.request_stats import histogram
from touchline.schema import CONSUME_SECONDS_BUCKETS
from touchline.sources.commits import Files
from touchline.streaming.consumer import offsets_behind
from touchline.streaming.sinks import BatchSink, parquet_batches

SUCCESS, ERROR = "success", "error"

MEASURES = T.StructType(
    [
        T.StructField("messages", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("topic", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("lag", T.LongType()),
        T.StructField("at", T.StringType()),
    ]
)


def timed(sink: BatchSink, topic: str, path: str, writer: str | None = None) -> BatchSink:
    """``sink``, with a row for each batch below ``path``: its messages, seconds and whether it was stored.

    A batch stored again replaces its row; a failure and the success that follows are a row each. The messages of a
    failed batch are counted anew, and unknown (null) if its rows cannot be read either.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        seen, started = Observation(), time.monotonic()
        try:
            sink(rows.observe(seen, F.count(F.lit(1)).alias("messages")), batch_id)
        except Exception:
            tell(rows, batch_id, ERROR, _counted(rows), time.monotonic() - started)
            raise
        seconds = time.monotonic() - started
        tell(rows, batch_id, SUCCESS, observed(seen, rows, messages=F.count(F.lit(1)))["messages"], seconds)

    def tell(rows: DataFrame, batch_id: int, status: str, messages: int | None, seconds: float) -> None:
        row = rows.sparkSession.createDataFrame([(messages, seconds)], "messages long, duration_s double")
        # Topic, status, writer and batch are told by the folders.
        parquet_batches(f"{path}/topic={topic}/status={status}", writer=writer)(row, batch_id)

    return write


def _counted(rows: DataFrame) -> int | None:
    try:
        return rows.count()
    except PySparkException:
        return None


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASURES).parquet(path)


def message_counters(measures: DataFrame) -> DataFrame:
    """Batches and messages by topic and status."""
    return measures.groupBy("topic", "status").agg(F.count("*").alias("batches"), F.sum("messages").alias("messages"))


def write_seconds(measures: DataFrame, bounds: Sequence[float] = CONSUME_SECONDS_BUCKETS) -> DataFrame:
    """Histogram of the seconds that batches took to be written, by topic."""
    return histogram(measures, "duration_s", bounds, by=["topic"])


class ProgressRows(StreamingQueryListener):
    """Writes what each micro-batch reports of itself to a file of its own below ``path``; :func:`read_progress` reads them.

    Register it with ``spark.streams.addListener``. Reports are written by the driver as they come, shortly after the batch, and
    a batch reported again does not count twice.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files = Files(spark, path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = json.loads(event.progress.json)
        row = {
            "query_id": told["id"],
            "batch_id": told["batchId"],
            "rows": told["numInputRows"],
            "duration_s": told.get("durationMs", {}).get("triggerExecution", 0) / 1000,
            "lag": sum(behind for _, _, behind in offsets_behind(told)),
            "at": told["timestamp"],
        }
        self.files.write_new(f"{row['query_id']}/{row['batch_id']:012d}.json", json.dumps(row))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
