"""The newest N rows of each key, kept up to date by a stream.

Each batch stores its own newest N rows of each key: more can never be among the newest of all. What no longer is goes
when the batches are folded. A batch reads nothing of what is stored, late rows count like others, and a repeated batch is
stored once. A key has at most N rows in a folded table, and N more for each batch since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.newest import newest
from touchline.schema import LATENCY_WINDOW
from touchline.sources.commits import CommittedTable
from touchline.streaming.sinks import writer_of

BUCKETS = 16
#: Larger than any bucket: a fold takes all files of a bucket.
WHOLE_BUCKET = 1 << 50


class NewestTable:
    """Rows of ``schema``; ``order`` must be unique within a key, as for :func:`touchline.operators.newest.newest`."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, order: Sequence[str], by: Sequence[str] = (),
        n: int = LATENCY_WINDOW, buckets: int = BUCKETS,
    ) -> None:
        self.columns, self.order, self.by, self.n, self.buckets = schema.fieldNames(), list(order), list(by), n, buckets
        held = T.StructType([*schema.fields, T.StructField("_bucket", T.StringType())])
        self.table = CommittedTable(spark, path, held, date_column="_bucket", cluster_by=tuple(by))

    def add(self, rows: DataFrame, writer: str, batch: int) -> None:
        # Without keys there is one list, in one bucket.
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)) if self.by else F.lit(0)
        self.table.append(self._newest(rows.select(*self.columns)).withColumn("_bucket", bucket.cast("string")), writer, batch)

    def read(self) -> DataFrame:
        return self._newest(self.table.read()).select(*self.columns)

    def fold(self) -> None:
        """Drops the rows that are among the newest no more, while batches go on."""
        self.table.compact(fold=self._newest, target_bytes=WHOLE_BUCKET)

    def stored_rows(self) -> int:
        version = self.table.version()
        return sum(f["rows"] for bucket in version.dates for f in self.table.manifest(version, bucket))

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest(rows, self.order, self.n, self.by)


def start_newest(
    rows: DataFrame, table: NewestTable, checkpoint: str, fold_every: int = 16, available_now: bool = False
) -> StreamingQuery:
    """Keeps ``table`` up to date with a stream; every ``fold_every`` batches it is folded."""

    def add(batch_rows: DataFrame, batch_id: int) -> None:
        table.add(batch_rows, writer_of(batch_rows), batch_id)
        if (batch_id + 1) % fold_every == 0:
            table.fold()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
