"""Token counts as delta-maintained rollups.

A store holds three tables below one folder, each with one part for each batch: the *ledger* of signed rows of documents (+1 for what
a batch brings, -1 for what it takes back), the *deltas* summed from it by source, language and tokenizer version, and the *commits*. Totals are
the sums of committed deltas; nothing that has been counted is read again. A part of the ledger is laid out by ``BUCKETS`` hashes of doc_id, and a
batch reads the buckets of the documents that it takes back.

An insert brings a document, a delete takes back all that the ledger holds of its doc_id, a revision does both. A batch writes its own parts and then its commit. Coming again after its commit it
changes nothing; coming again after it broke off, it replaces its own parts, and until its commit no reader counts them. Batches of one store are committed one after the other.

Defined cases: null texts have 0 tokens. A null source or language is a group of its own. A null doc_id can be inserted, but no delete or revision meets it. Deletes of unknown documents change nothing, revisions of
them insert. Rows repeated in a batch's inserts count each; of its revisions of one doc_id each counts, the old rows go once. Groups back at no document vanish from the totals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import short_batches, stored
from touchline.session import new_run_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text before merging: contractions, words with a leading blank, numbers, other runs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VERSION = "byte_bpe_50k/1"
LONG_BLANKS = re.compile(r"\s{4096}")

#: Folders of a ledger part.
BUCKETS = 64

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ["source", "lang", "tokenizer"]

LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, sign long"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
COMMITS = "rows long"
_TABLES = {"ledger": f"{LEDGER}, bucket int", "deltas": DELTAS, "commits": COMMITS}


# -- counting


def tokens_of(encoding, text: str) -> int:
    """Tokens of a text. The encoder's own cutting of the text gives up on very long runs of white space, so a text that
    holds one is cut here, by the same pattern in an engine that takes them in a linear scan, and encoded piece by piece."""
    if not LONG_BLANKS.search(text):
        return len(encoding.encode_ordinary(text))
    import regex

    return sum(pieces_tokens(encoding, m[0]) for m in regex.finditer(PATTERN, text))


def pieces_tokens(encoding, piece: str) -> int:
    return len(encoding._encode_single_piece(piece))


def counted(texts: DataFrame, columns: dict[str, str], path: str = VOCABULARY) -> DataFrame:
    """``texts`` with a token count for each text column: ``columns`` maps new names to text columns, which are left out."""
    spark = texts.sparkSession
    short_batches(spark)
    with open(path, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())
    kept = [f for f in texts.schema.fields if f.name not in columns.values()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` long" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in held.value.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            made = []
            for text in columns.values():
                values = batch.column(text).to_pylist()
                made.append(pa.array([tokens_of(encoding, v) if v else 0 for v in values], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, [f.name for f in kept] + list(columns))

    return texts.mapInArrow(run, schema)


# -- the store


def create(spark: SparkSession, path: str) -> str:
    """An empty store below ``path``."""
    for table, schema in _TABLES.items():
        part = f"{path}/{table}/batch=none"
        if table == "ledger":
            spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{part}/bucket=0")
        else:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(part)
    return path


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(f"{_TABLES[table]}, batch string").parquet(f"{path}/{table}")


def _committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of committed batches; one commit row for each batch."""
    done = _read(spark, path, "commits").select("batch").distinct()
    return _read(spark, path, table).join(done, "batch", "left_semi").drop("batch")


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return not _read(spark, path, "commits").where(F.col("batch") == batch).isEmpty()


def named_buckets(path: str, named: DataFrame) -> DataFrame:
    """The committed ledger's buckets that may hold the documents of ``named``."""
    # At most BUCKETS numbers.
    buckets = [r["b"] for r in named.where("doc_id is not null").select(bucket_of(F.col("doc_id")).alias("b")).distinct().collect()]
    return _committed(named.sparkSession, path, "ledger").where(F.col("bucket").isin(buckets))


def commit(path: str, batch: str, changes: DataFrame) -> bool:
    """Applies a batch of (op, doc_id, source, lang, tokenizer, tokens); False if it had been applied before."""
    spark = changes.sparkSession
    if is_committed(spark, path, batch):
        return False
    columns = ["doc_id", *GROUP, "tokens"]
    brought = changes.where(F.col("op").isin(INSERT, REVISE)).select(*columns).withColumn("sign", F.lit(1).cast("long"))
    named = changes.where(F.col("op").isin(DELETE, REVISE)).select("doc_id", "tokenizer").distinct()
    # A document's rows under other tokenizer versions stay.
    held = named_buckets(path, named).join(named, ["doc_id", "tokenizer"], "left_semi")
    taken = held.groupBy(*columns).agg((-F.sum("sign")).alias("sign")).where("sign <> 0")
    part = brought.unionByName(taken).withColumn("bucket", bucket_of(F.col("doc_id"))).hint("rebalance", "bucket")
    part.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ledger/batch={batch}")
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/ledger/batch={batch}")
    deltas = ledger.groupBy(*GROUP).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    deltas.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")
    ledger.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """documents and tokens by source, lang and tokenizer."""
    sums = _committed(spark, path, "deltas").groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where("documents <> 0 or tokens <> 0")


# -- the history that the query replays


def history(documents: DataFrame, labels: DataFrame) -> list[tuple[str, DataFrame]]:
    """All documents come in; toxic ones are withdrawn; the other texts of low quality are cut to their first line.

    The batches come in an order with repeats, as from a feed that delivers at least once.
    """
    first_line = F.regexp_extract("text", r"^([^\n]*)", 1)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text", first_line.alias("line"))
    rows = stored(counted(rows, {"tokens": "text", "line_tokens": "line"}), "counts").withColumn("tokenizer", F.lit(VERSION))
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = rows.join(marks, "doc_id")

    def batch(op: str, chosen: DataFrame, tokens: str = "tokens") -> DataFrame:
        return chosen.select(F.lit(op).alias("op"), "doc_id", *GROUP, F.col(tokens).alias("tokens"))

    load = ("load", batch(INSERT, rows))
    withdrawn = ("withdrawn", batch(DELETE, marked.where("toxic = 1")))
    cut = ("cut", batch(REVISE, marked.where("quality = 0 and coalesce(toxic, 0) <> 1"), "line_tokens"))
    return [load, withdrawn, load, cut, withdrawn, cut]


def maintained(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after the history of ``history``."""
    spark = documents.sparkSession
    path = create(spark, new_run_dir(spark, "rollups"))
    reduce(lambda _, step: commit(path, *step), history(documents, labels), None)
    return totals(spark, path)
