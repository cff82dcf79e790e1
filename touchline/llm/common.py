"""What the operators of this subpackage share: tables, word rules, Arrow batches, tables between steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import new_run_dir

#: Rows of one Arrow batch. Texts can be long, so batches are kept short to bound a Python worker's memory.
BATCH_ROWS = 256

#: The separators of a text's words where punctuation belongs to the word.
SPACES = "\\x20\\x09-\\x0D"
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"

_LOWER = {b: b + 32 for b in range(0x41, 0x5B)}


def _table(is_word) -> bytes:
    return bytes(_LOWER.get(b, b) if is_word(b) else 0x20 for b in range(256))


#: UTF-8 bytes to lower-case words apart by single bytes 0x20. Bytes from 0x80 on belong to letters outside ASCII.
ALNUM_WORDS = _table(lambda b: b >= 0x80 or chr(b).isalnum())
SPACED_WORDS = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return [] if text is None else text.translate(ALNUM_WORDS).split()


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return [] if text is None else text.translate(SPACED_WORDS).split()


def find_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package from wherever the session was started."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: lineage ends in files every executor can reach."""
    path = f"{new_run_dir(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_for_now(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Tables:
    """Tables between the steps of one job, below one run folder: as :func:`stored`, but they can be dropped once no step reads them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made, self.paths = spark, new_run_dir(spark, name), 0, {}

    def put(self, name: str, parts: DataFrame | Iterable[DataFrame], dealt: int = 1) -> DataFrame:
        """The rows of all ``parts``, each written before the next one is asked for. A table that had the name is dropped after that.

        A part's shuffle files go as soon as it is written, not when the driver happens to collect its garbage. Parts with one of ``dealt``
        shares of the rows are shuffled to as many fewer partitions.
        """
        path = f"{self.root}/{self.made}-{name}"
        self.made += 1
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        least = min(most, 2 * self.spark.sparkContext.defaultParallelism)
        settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffle.partitions": str(max(most // dealt, least))}
        for part in [parts] if isinstance(parts, DataFrame) else parts:
            with set_for_now(self.spark, settings):
                part.write.mode("append").option("compression", "zstd").parquet(path)
            schema = part.schema
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        self.drop(*(set(self.paths) - set(names)))


def id_text(column: str = "doc_id") -> Column:
    """An identifier as text; null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(id_text(column).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, bound: int, salt: str, column: str = "doc_id") -> DataFrame:
    """Rows of distinct ids with the lowest 64-bit hashes, ``bound`` of them or all if there are fewer.

    Hashes are counted by their leading bits, and those of the step in which the bound lies by the bits that follow.
    """
    digest = F.xxhash64(column, F.lit(salt))
    chosen, prefix, left = F.lit(False), F.lit(True), bound
    for used in range(0, 64, 12):
        bits = min(12, 64 - used)
        step = F.shiftrightunsigned(digest, 64 - used - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        sizes = {r["s"]: r["n"] for r in rows.where(prefix).groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
        for s in sorted(sizes):
            if sizes[s] > left:
                break
            left -= sizes[s]
        else:
            return rows.where(chosen | prefix)
        chosen, prefix = chosen | (prefix & (step < s)), prefix & (step == s)
        if left == 0:
            break
    return rows.where(chosen)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to clash with no column (in any case of letters)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def utf8(column: str = "text") -> Column:
    """A text column as its UTF-8 bytes, which Python reads without decoding."""
    return F.col(column).cast("binary")


def per_row(df: DataFrame, column: str, compute, schema: T.StructType, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and the values ``compute`` gives for each value of a binary ``column``.

    ``compute`` is called once in a task and returns a function of one value to a tuple in the order of ``schema``.
    """
    kept = df.select(*keep).schema.fields
    out = T.StructType([*kept, *schema.fields])
    arrow_types = [_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = compute()
        for batch in batches:
            rows = [one(value) for value in batch.column(column).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow_types)
            made = [pa.array(values, t) for values, t in zip(columns, arrow_types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, out.names)

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, out)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }[kind.simpleString()]
