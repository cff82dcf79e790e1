"""The ledger as additive versions: a retry run appends what it changes instead of rewriting the ledger.

An entry is stored once, with its document. A run adds narrow rows (id, version, retry_count, resent), and reading merges them:
the row of the highest version is the entry's state. Rows are laid out by a hash of the id, so that an entry and its
changes share a bucket, and appending goes through the commit log: a run that is repeated after a crash, before or after
its changes were published, changes the ledger once. Now and then :meth:`fold` merges the rows of each bucket.

One retry run works at a time, as its changes follow from the states that it has read; new entries may be added meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.ledger import FAILED, RESENT
from touchline.schema import LEDGER
from touchline.sources.commits import CommittedTable

BUCKETS = 64
#: Larger than any bucket: a fold takes all files of a bucket, so that no change outlives its entry.
WHOLE_BUCKET = 1 << 50

CHANGES = T.StructType(
    [
        *LEDGER.fields,
        T.StructField("version", T.LongType()),
        T.StructField("resent", T.BooleanType()),
        T.StructField("is_entry", T.BooleanType()),
        T.StructField("bucket", T.StringType()),
    ]
)


class VersionedLedger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self.table = CommittedTable(spark, path, CHANGES, date_column="bucket", cluster_by=("id",))

    def add(self, entries: DataFrame, writer: str, batch: int) -> None:
        """Adds new entries; their ids are in no earlier batch."""
        rows = entries.select(*LEDGER.fieldNames(), F.lit(0).cast("long").alias("version"))
        self._append(rows, F.lit(False), True, writer, batch)

    def apply(self, run: DataFrame, batch: int, writer: str = "retry-runs") -> None:
        """Adds what a run over :meth:`current` changes: resent entries end, failed ones have one more try behind them.

        ``batch`` numbers the runs. Entries that the run skipped stay as they are and cost no row.
        """
        changed = run.filter(F.col("result").isin(RESENT, FAILED))
        tried = F.when(F.col("result") == FAILED, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
        nothing = {name: F.lit(None).cast(LEDGER[name].dataType) for name in ("event_data", "failure_reason", "created_at")}
        rows = changed.select(
            "id",
            *[value.alias(name) for name, value in nothing.items()],
            tried.alias("retry_count"),
            (F.col("version") + 1).alias("version"),
            "result",
        )
        self._append(rows, F.col("result") == RESENT, False, writer, batch)

    def _append(self, rows: DataFrame, resent, is_entry: bool, writer: str, batch: int) -> None:
        rows = rows.withColumns({"resent": resent, "is_entry": F.lit(is_entry), "bucket": self._bucket()})
        self.table.append(rows, writer, batch)

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("string")

    def current(self) -> DataFrame:
        """The entries not yet sent, with their ``version``."""
        return _states(self.table.read()).drop("bucket")

    def history(self) -> DataFrame:
        """The changes not yet folded: id, version, retry_count and whether the entry was sent."""
        return self.table.read().filter(~F.col("is_entry")).select("id", "version", "retry_count", "resent")

    def fold(self) -> None:
        """Stores the current state of each bucket as entries; sent ones and merged changes go. Readers and writers go on."""

        def once(rows: DataFrame) -> DataFrame:
            return _states(rows).withColumns({"resent": F.lit(False), "is_entry": F.lit(True)})

        self.table.compact(fold=once, target_bytes=WHOLE_BUCKET)


def _states(rows: DataFrame) -> DataFrame:
    """Entries with their state of the highest version, if that is not sent.

    States are merged as one number, which hash aggregation keeps in place and combines before the shuffle;
    the documents travel once, to the join.
    """
    version, tries = F.shiftleft(F.col("version"), 32), F.shiftleft(F.col("retry_count").cast("long"), 1)
    state = F.max(version + tries + F.col("resent").cast("int"))
    latest = rows.groupBy(F.col("id").alias("_id")).agg(state.alias("_state"))
    latest = latest.filter(F.col("_state").bitwiseAND(F.lit(1)) == 0)
    entries = rows.filter("is_entry").drop("version", "retry_count", "resent", "is_entry")
    joined = entries.join(latest, F.col("id") == F.col("_id")).withColumns(
        {
            "version": F.shiftright("_state", 32),
            "retry_count": F.shiftright(F.col("_state").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int"),
        }
    )
    return joined.select(*LEDGER.fieldNames(), "version", "bucket")
