"""Topics: Kafka where the connector is on the class path, else a Parquet folder of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schema import BATCH_INTERVAL, BATCH_ROWS, TOPIC


#: Rows of one batch at most, so that a backlog is not taken as one.
MAX_BATCH_ROWS = 1_000_000
#: Bytes of a row group of a topic file, before compression; one task decodes at least one.
ROW_GROUP_BYTES = 4 << 20


def kafka_options(servers: str, topic: str, max_rows_per_batch: int = MAX_BATCH_ROWS) -> dict[str, str]:
    """Reader options: from the first offset, a batch at 1,000 rows or 5 seconds, 10 MB fetches.

    A backlog is worked off in batches of ``max_rows_per_batch``.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "includeHeaders": "true",
        "kafka.fetch.max.bytes": "10000000",
        "minOffsetsPerTrigger": str(BATCH_ROWS),
        "maxTriggerDelay": BATCH_INTERVAL,
        "maxOffsetsPerTrigger": str(max_rows_per_batch),
    }


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, **more: str) -> DataFrame:
    """Stream of a Kafka topic (needs the spark-sql-kafka connector)."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic)).options(**more)
    return reader.load().select(*TOPIC.fieldNames())


def read_topic_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of a topic kept as a Parquet folder; a backlog is worked off in batches of files."""
    return (
        spark.readStream.schema(TOPIC)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a topic kept as a Parquet folder."""
    return spark.read.schema(TOPIC).option("recursiveFileLookup", "true").parquet(path)


def append_to_topic(rows: DataFrame, path: str) -> None:
    """Append topic rows to a Parquet folder.  Partition and offset are a broker's to give, so they stay as they are or NULL.

    Row groups are small, so that many tasks share a batch that is one file.
    """
    missing = [c for c in TOPIC.fieldNames() if c not in rows.columns]
    full = rows.withColumns({c: F.lit(None).cast(TOPIC[c].dataType) for c in missing})
    full.select(*TOPIC.fieldNames()).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def write_to_kafka(rows: DataFrame, servers: str) -> None:
    """Publish topic rows with all acknowledgements (needs the connector)."""
    (
        rows.select("key", "value", "headers", "topic")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("includeHeaders", "true")
        .save()
    )
