"""A stored table whose readers plan from manifests instead of listing folders.

A version of the table is one small file that names, for each date, the manifest of that date's data files. It is published by
renaming it to the next version's name, which fails if that name is taken; then the change is applied to the newer
version and tried again. Readers see a whole version or the one before it, whatever is being written, repeated
or compacted meanwhile. Only the last versions are kept, so listing them does not grow with the number of batches,
and a change rewrites the manifests of the dates it touches only.

Files are written by Spark to folders of their own and never changed. With an ``id_column`` each file has a Bloom filter of its
ids, so that a search for repeats reads only the files that may hold one.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions kept for readers that planned from them, and tries to publish when others publish at the same time.
KEEP_VERSIONS, TRIES = 20, 50
#: Bytes of a file that compaction aims at; files of at least half of it are left alone.
TARGET_BYTES = 256 << 20
#: Bits of a Bloom filter for each id, its hashes, and the bits of one stored piece of it.
BLOOM_BITS, BLOOM_HASHES, PIECE_BITS = 12, 6, 32_768
#: Dates of one batch whose manifests are opened when repeats are looked for, and ids of a date that are always looked up in filters.
MAX_BATCH_DATES, FEW_IDS = 10_000, 1000

_PART = "_part"


def within(stored: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The stored rows between the least and the greatest value of a column of ``rows``; Parquet passes over row groups without any."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return stored.where(F.lit(False)) if low is None else stored.where(F.col(column).between(low, high))


class Files:
    """Small files below a folder, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        hadoop = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(hadoop)
        # Renaming without replacing is offered by the file context only.
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), hadoop)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether ``name`` was free and now holds ``text``, all of it at once."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), True)
        stream.write(text.encode())
        stream.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(self.path(draft), self.path(name), options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.toString()):
                raise
            self.delete(draft)
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: The manifest of each date, as a file name below ``_log``.
    dates: dict[str, str] = field(default_factory=dict)
    #: The last batch of each writer.
    writers: dict[str, int] = field(default_factory=dict)


class CommittedTable:
    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, date_column: str = "event_date",
        id_column: str | None = None, cluster_by: tuple[str, ...] = (),
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.date_column, self.id_column, self.cluster_by = date_column, id_column, cluster_by
        self.files = Files(spark, self.path)

    # -- versions

    def version(self, number: int | None = None) -> Version:
        """The given version, or the newest; an empty one where nothing has been published."""
        while True:
            held = [n for n in self.files.names("_log") if n.startswith("v") and n.endswith(".json")]
            name = f"v{number:012d}.json" if number is not None else held[-1] if held else None
            if name is None:
                return Version()
            try:
                return Version(**json.loads(self.files.read(f"_log/{name}")))
            except Py4JJavaError:
                # Dropped as too old between listing and reading, which can only befall one that is not the newest any more.
                if number is not None or name in self.files.names("_log"):
                    raise

    def manifest(self, version: Version, date: str) -> list[dict]:
        """path, rows, bytes, ids and pieces of the date's files."""
        name = version.dates.get(date)
        return json.loads(self.files.read(f"_log/{name}")) if name else []

    def _publish(self, change: Callable[[Version], tuple[dict[str, list[dict]], dict[str, int]] | None]) -> Version:
        """Publishes what ``change`` makes of the newest version: new manifests of some dates, last batches of some writers."""
        for attempt in range(TRIES):
            now = self.version()
            changed = change(now)
            if changed is None:
                return now
            dates = dict(now.dates)
            for date, files in changed[0].items():
                dates.pop(date, None)
                if files:
                    dates[date] = f"files/{uuid.uuid4().hex}.json"
                    self.files.write_new(f"_log/{dates[date]}", json.dumps(files))
            new = Version(now.number + 1, dates, {**now.writers, **changed[1]})
            if self.files.write_new(f"_log/v{new.number:012d}.json", json.dumps(new.__dict__)):
                for name in self.files.names("_log"):
                    if name.startswith("v") and name < f"v{new.number - KEEP_VERSIONS + 1:012d}.json":
                        self.files.delete(f"_log/{name}")
                return new
            time.sleep(0.01 * attempt)
        raise RuntimeError(f"{TRIES} tries to publish in {self.path} met others that published")

    # -- reading

    def read(self, first_date: str | None = None, last_date: str | None = None, version: Version | None = None) -> DataFrame:
        """The rows of a version; only the manifests and files of the given dates are opened."""
        version = version or self.version()
        wanted = [d for d in sorted(version.dates) if (first_date is None or d >= first_date) and (last_date is None or d <= last_date)]
        return self._rows([f["path"] for d in wanted for f in self.manifest(version, d)])

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    # -- writing

    def append(self, rows: DataFrame, writer: str, batch: int) -> Version:
        """Adds a writer's batch; batches up to the writer's last one are there already and leave the table as it is.

        A try that ends before it publishes leaves files that no version names; :meth:`vacuum` deletes them.
        """
        if self._has(self.version(), writer, batch):
            return self.version()
        added = self._write(rows.hint("rebalance", self.date_column))

        def add(now: Version):
            if self._has(now, writer, batch):
                return None
            return {d: self.manifest(now, d) + files for d, files in added.items()}, {writer: batch}

        return self._publish(add)

    @staticmethod
    def _has(version: Version, writer: str, batch: int) -> bool:
        return version.writers.get(writer, -1) >= batch

    def append_new(self, rows: DataFrame, writer: str, batch: int) -> Version:
        """Adds the rows whose id is not stored yet under its date, one row an id: the least in the order of all columns."""
        version = self.version()
        if self._has(version, writer, batch):
            return version
        columns = self.schema.fieldNames()
        keys = [self.date_column, self.id_column]
        others = [c for c in columns if c not in keys]
        # Kept for the search and the write, so that the batch is read and decoded once.
        rows = rows.select(*columns).persist()
        # A repeated id is folded on the map side, so one with many copies meets as few rows.
        once = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(*columns)
        try:
            new, found = once, self.holding(once, version)
            if found:
                stored = within(self._rows(found).select(*keys), rows, self.id_column)
                same = once[self.date_column].eqNullSafe(stored[self.date_column]) & (once[self.id_column] == stored[self.id_column])
                new = once.join(stored, same, "left_anti")
            return self.append(new, writer, batch)
        finally:
            rows.unpersist()

    def holding(self, rows: DataFrame, version: Version) -> list[str]:
        """The files that may hold one of the rows' ids under its date, by their Bloom filters.

        To ask a filter makes ``BLOOM_HASHES`` rows of an id. A file that has no more rows than that makes for all ids of
        its date is taken unasked, as its own ids are read sooner.
        """
        counted = rows.groupBy(self._date().alias("d")).agg(F.count(self.id_column).alias("ids"))
        dates = {r["d"]: r["ids"] for r in counted.limit(MAX_BATCH_DATES + 1).collect()}
        if len(dates) > MAX_BATCH_DATES:
            raise ValueError(f"a batch of more than {MAX_BATCH_DATES} dates")
        listed = [(d, f) for d in dates for f in self.manifest(version, d) if f["ids"]]
        read = [f["path"] for d, f in listed if dates[d] > FEW_IDS and f["rows"] <= BLOOM_HASHES * dates[d]]
        unasked = set(read)
        files = [(d, f["path"], f["pieces"], f["ids"]) for d, f in listed if f["path"] not in unasked]
        if not files:
            return sorted(read)
        listed = self.spark.createDataFrame([f[:3] for f in files], "date string, path string, pieces int")
        filters = self.spark.read.parquet(*sorted({f"{self.path}/{f[3]}" for f in files}))
        asked = rows.select(self._date().alias("date"), F.col(self.id_column).alias("_id")).join(F.broadcast(listed), "date")
        asked = asked.select("path", "_id", F.explode(self._positions(F.col("_id"), F.col("pieces"))).alias("at"))
        asked = asked.select("path", "_id", F.floor(F.col("at") / PIECE_BITS).cast("int").alias("piece"), (F.col("at") % PIECE_BITS).cast("int").alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) > 0
        met = asked.join(filters, ["path", "piece"]).where(held).groupBy("path", "_id").agg(F.count("*").alias("n"))
        return sorted(read + [r["path"] for r in met.where(F.col("n") == BLOOM_HASHES).select("path").distinct().collect()])

    def _positions(self, id_: Column, pieces: Column) -> Column:
        # Eight bits fewer, so that the sums stay in range.
        one, two = (F.shiftright(h, 8) for h in (F.xxhash64(id_), F.xxhash64(id_, F.lit("step"))))
        bits = pieces.cast("long") * PIECE_BITS
        return F.array(*[F.pmod(one + F.lit(i).cast("long") * two, bits) for i in range(BLOOM_HASHES)])

    def _date(self) -> Column:
        return F.coalesce(F.col(self.date_column).cast("string"), F.lit("none"))

    def _write(self, rows: DataFrame) -> dict[str, list[dict]]:
        """Writes the rows and tells their files by date."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.schema.fieldNames()
        rows.select(*columns, self._date().alias(_PART)).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        if not any(n.startswith(_PART) for n in self.files.names(folder)):
            return {}
        read = T.StructType([*self.schema.fields, T.StructField(_PART, T.StringType())])
        written = self.spark.read.schema(read).parquet(f"{self.path}/{folder}")
        path = F.concat(F.lit(f"{folder}/{_PART}="), F.col(_PART), F.lit("/"), F.col("_metadata.file_name"))
        files = written.groupBy(F.col(_PART).alias("date"), path.alias("path"), F.col("_metadata.file_size").alias("bytes"))
        told = files.agg(F.count("*").alias("rows")).collect()
        ids, pieces = None, 0
        if self.id_column and told:
            ids = f"_log/ids/{uuid.uuid4().hex}"
            pieces = max(1, math.ceil(max(r["rows"] for r in told) * BLOOM_BITS / PIECE_BITS))
            at = written.select(path.alias("path"), F.explode(self._positions(F.col(self.id_column), F.lit(pieces))).alias("at"))
            bit = F.bitmap_construct_agg((F.col("at") % PIECE_BITS).cast("long"))
            at.groupBy("path", F.floor(F.col("at") / PIECE_BITS).cast("int").alias("piece")).agg(bit.alias("bits")).write.parquet(f"{self.path}/{ids}")
        found: dict[str, list[dict]] = {}
        for r in sorted(told, key=lambda r: r["path"]):
            found.setdefault(r["date"], []).append({"path": r["path"], "rows": r["rows"], "bytes": r["bytes"], "ids": ids, "pieces": pieces})
        return found

    # -- upkeep

    def compact(
        self, before: str | None = None, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows, target_bytes: int = TARGET_BYTES
    ) -> Version:
        """Packs the small files of each date before ``before`` into clustered ones of about ``target_bytes``.

        ``fold`` may merge rows that add up. What is appended meanwhile stays beside the packed files; if another
        compaction was faster, its result stands. Readers of older versions keep their files until :meth:`vacuum`.
        """
        start = self.version()
        for date in sorted(d for d in start.dates if before is None or d < before):
            small = [f for f in self.manifest(start, date) if 2 * f["bytes"] < target_bytes]
            if len(small) < 2:
                continue
            parts = max(1, round(sum(f["bytes"] for f in small) / target_bytes))
            rows = fold(self._rows([f["path"] for f in small]))
            rows = rows.repartitionByRange(parts, *self.cluster_by) if self.cluster_by else rows.repartition(parts)
            packed = self._write(rows.sortWithinPartitions(*self.cluster_by) if self.cluster_by else rows)
            gone = {f["path"] for f in small}

            def swap(now: Version, date=date, gone=gone, packed=packed):
                held = self.manifest(now, date)
                if not gone <= {f["path"] for f in held}:
                    return None
                return {date: [f for f in held if f["path"] not in gone] + packed.get(date, [])}, {}

            self._publish(swap)
        return self.version()

    def vacuum(self, older_than_s: float) -> list[str]:
        """Deletes folders that no kept version names and that were written longer ago than any running write or read takes."""
        versions = [self.version(int(n[1:13])) for n in self.files.names("_log") if n.startswith("v") and n.endswith(".json")]
        manifests = {name: json.loads(self.files.read(f"_log/{name}")) for name in {m for v in versions for m in v.dates.values()}}
        named = {"_log/" + m for m in manifests}
        for files in manifests.values():
            named |= {f["ids"] for f in files if f["ids"]} | {"/".join(f["path"].split("/")[:2]) for f in files}
        dropped = []
        for folder in ("data", "_log/files", "_log/ids"):
            for name in self.files.names(folder):
                where = f"{folder}/{name}"
                age = time.time() - self.files.fs.getFileStatus(self.files.path(where)).getModificationTime() / 1000
                if where not in named and age >= older_than_s:
                    self.files.delete(where)
                    dropped.append(where)
        return dropped
