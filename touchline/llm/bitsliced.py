"""Ranked lexical search over bit-sliced Bloom signatures, exact.

Index: documents of like vocabulary size are put together in blocks. A block has a Bloom filter per document, stored by
slice: row s of the block is a bitmap over its documents, the documents whose filter has bit s. A document's filter holds
each of its terms, and once more for each of the levels 2, 4, 8 and 16 that the term's count reaches, so that the bitmaps
overestimate presence and, through the levels, counts.

Search: for a term, the rows of its bits are ANDed, level by level, which bounds its count in every document of the block,
and the weighted contributions of an item's terms add up to an upper bound of each document's score. The documents of the
highest bounds are scored exactly first; the k-th best of these scores is the item's threshold. Then every document whose
bound reaches the threshold is scored exactly, so only documents that provably cannot be among the k best are left out.

Items are taken in blocks whose terms number ``BLOCK_TERMS``, or one item if it has more. Only such a block goes to the
tasks whole. Texts are joined with the documents to score by a digest of the row. Each task passes on its k best only.

Defined cases: a null or empty text has no terms, counts in nothing and is never found; an item without terms, or whose
terms no document holds, has no rows. A null item_id is an item like others. Repeated items (rows of one item_id) are
ranked row by row, each from 1. Repeated documents are rows of their own; a null doc_id comes after all others of its
score. An empty table of documents or items gives no rows. Long texts are taken whole: the number of slices follows the
document's terms. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import alnum_words, id_text, short_batches, stored, utf8

K = 20
#: Counts from which a term is entered once more.
LEVELS = (1, 2, 4, 8, 16)
#: Bits per term at least (twice as many at most), and rows per term.
BITS, ROWS = 8, 4
#: Documents of a block at most, and cells (bits of all its documents) it aims at.
BLOCK_DOCS, BLOCK_CELLS = 1024, 1 << 23
#: Terms of a block of items.
BLOCK_TERMS = 200_000
#: Documents with the highest bounds that are scored for an item's threshold.
SEEDS = 2 * K

INDEX = "bits int, rows binary, keys array<binary>, ids array<bigint>, n array<bigint>"


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text as bytes and a digest of both. Rows alike in both share it, and score the same."""
    text = F.coalesce(utf8(), F.lit(b""))
    key = F.unhex(F.md5(F.concat(id_text().cast("binary"), F.lit(b"|"), text)))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))


def _hashes() -> callable:
    """Terms and levels to 64-bit hashes, alike in every process; the last ones are remembered."""
    from hashlib import blake2b

    seen: dict[tuple[bytes, int], int] = {}

    def hashed(term: bytes, level: int) -> int:
        got = seen.get((term, level))
        if got is None:
            if len(seen) > 200_000:
                seen.clear()
            got = int.from_bytes(blake2b(term, digest_size=8, salt=level.to_bytes(2, "big")).digest(), "big")
            seen[term, level] = got
        return got

    return hashed


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The rows of each hash, ``ROWS`` a hash, in a filter of ``2 ** bits`` bits."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    at = hashes[:, None] + step[:, None] * np.arange(ROWS, dtype=np.uint64)[None, :]
    return (at & np.uint64((1 << bits) - 1)).astype(np.int64)


def index(documents: DataFrame) -> DataFrame:
    """Blocks of documents with their slices. Documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashes()
        waiting: dict[int, list[tuple]] = {}
        schema = pa.schema(
            [("bits", pa.int32()), ("rows", pa.binary()), ("keys", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
        )

        def block(bits: int) -> pa.RecordBatch:
            docs = waiting.pop(bits)
            cells = np.zeros((1 << bits, len(docs)), bool)
            for d, doc in enumerate(docs):
                cells[_positions(doc[3], bits).reshape(-1), d] = True
            packed = np.packbits(cells, axis=1).tobytes()
            columns = [[bits], [packed], [[d[0] for d in docs]], [[d[1] for d in docs]], [[d[2] for d in docs]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                words = alnum_words(text)
                if not words:
                    continue
                entries = [hashed(t, level) for t, c in Counter(words).items() for level in LEVELS if c >= level]
                bits = (len(entries) * BITS - 1).bit_length()
                waiting.setdefault(bits, []).append((key, doc_id, len(words), np.array(entries, np.uint64)))
                if len(waiting[bits]) >= min(BLOCK_DOCS, max(8, BLOCK_CELLS >> bits)):
                    yield block(bits)
        for bits in sorted(waiting):
            yield block(bits)

    return keyed(documents).mapInArrow(run, INDEX)


class Items:
    """A block of items as the tasks need it: distinct terms, and for each the items that hold it and how often."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        counts = [Counter(alnum_words(text)) for _, text in rows]
        self.names = [name for name, _ in rows]
        self.terms = sorted(set().union(*counts)) if counts else []
        number = {t: i for i, t in enumerate(self.terms)}
        self.of_item = [[(number[t], c) for t, c in sorted(one.items())] for one in counts]
        self.weights: list[int] = []
        self.total, self.length = 0, 0

    def learn(self, total: int, length: int, df: dict[int, int]) -> None:
        self.total, self.length = total, length
        self.weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))]

    def penalty(self, n):
        return 12 * (75 + (25 * n * self.total) // self.length)


def item_rows(benchmark: DataFrame) -> DataFrame:
    """Items by number, with their terms counted. Items without terms are left out."""
    import pyspark.sql.types as T

    from touchline.llm.common import per_row

    rows = benchmark.select("item_id", F.coalesce(utf8(), F.lit(b"")).alias("text"))
    schema = T.StructType([T.StructField("terms", T.LongType())])
    counted = per_row(rows, "text", lambda: lambda text: (len(alnum_words(text)),), schema, ["item_id", "text"])
    return stored(counted.where("terms > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def frequencies(documents: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """The number of documents that hold each of the block's terms."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(number.keys() & set(alnum_words(text)))
        rows = [(number[t], c) for t, c in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["term", "df"])

    parts = documents.select(utf8().alias("text")).mapInArrow(run, "term long, df long")
    return {r["term"]: r["df"] for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def bounds(n: np.ndarray, bits: int, packed: bytes, items: Items, hashes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """An upper bound of each document's score, item by item."""
    docs = len(n)
    rows = np.frombuffer(packed, np.uint8).reshape(1 << bits, -1)
    most = [np.minimum(n, 2 * level - 1) for level in LEVELS[:-1]] + [n]
    penalty = items.penalty(n)
    worth = [(1_000_000_000 * tf) // (1000 * tf + penalty) for tf in most]
    places = [_positions(h, bits) for h in hashes]
    memo: dict[int, np.ndarray | None] = {}

    def part(term: int) -> np.ndarray | None:
        if term not in memo:
            value, held = None, None
            for level, place in enumerate(places):
                here = np.bitwise_and.reduce(rows[place[term]], axis=0)
                held = here if held is None else held & here
                if not held.any():
                    break
                there = np.unpackbits(held, count=docs).view(bool)
                value = np.where(there, worth[level], 0 if value is None else value)
            memo[term] = None if value is None else value * items.weights[term]
        return memo[term]

    for item, terms in enumerate(items.of_item):
        total = np.zeros(docs, np.int64)
        for term, count in terms:
            if (value := part(term)) is not None:
                total += count * value
        yield item, total


def candidates(blocks: DataFrame, items: Items, thresholds: list[int] | None) -> DataFrame:
    """item, key and bound of the documents to score: the ``SEEDS`` highest bounds of a task, or all that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashes()
        hashes = [np.array([hashed(t, level) for t in items.terms], np.uint64) for level in LEVELS]
        best: list[list[tuple[int, int, bytes]]] = [[] for _ in items.names]

        def rows(found: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["item", "key", "bound"])

        for batch in batches:
            for bits, packed, keys, n in zip(*(batch.column(c).to_pylist() for c in ("bits", "rows", "keys", "n")), strict=True):
                found = []
                for item, total in bounds(np.array(n, np.int64), bits, packed, items, hashes):
                    if thresholds is not None:
                        found += [(item, keys[d], int(total[d])) for d in np.flatnonzero((total > 0) & (total >= thresholds[item]))]
                        continue
                    held = best[item]
                    least = held[0][0] if len(held) == SEEDS else 0
                    for d in np.flatnonzero(total > least):
                        if len(held) < SEEDS:
                            heapq.heappush(held, (int(total[d]), keys[d]))
                        elif total[d] > held[0][0]:
                            heapq.heapreplace(held, (int(total[d]), keys[d]))
                if found:
                    yield rows(found)
        if thresholds is None:
            yield rows([(item, key, bound) for item, held in enumerate(best) for bound, key in held])

    return blocks.select("bits", "rows", "keys", "n").mapInArrow(run, "item int, key binary, bound long")


def scored(documents: DataFrame, chosen: DataFrame, items: Items, thresholds: list[int] | None) -> DataFrame:
    """The exact scores of the chosen documents, the ``K`` best of each item and task."""
    wanted = chosen.groupBy("key").agg(F.collect_set("item").alias("items"))
    rows = documents.join(wanted, "key").select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The K best: the highest scores, and of these the smallest ids, null last.
        best: list[list[tuple]] = [[] for _ in items.names]
        for batch in batches:
            for doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                words = alnum_words(text)
                tf, penalty = Counter(words), items.penalty(len(words))
                for item in asked:
                    score = 0
                    for term, count in items.of_item[item]:
                        if t := tf.get(items.terms[term]):
                            score += count * items.weights[term] * ((1_000_000_000 * t) // (1000 * t + penalty))
                    if score > 0 and (thresholds is None or score >= thresholds[item]):
                        entry = (score, doc_id is not None, -(doc_id or 0))
                        if len(best[item]) < K:
                            heapq.heappush(best[item], entry)
                        else:
                            heapq.heappushpop(best[item], entry)
        out = [(item, -minus if known else None, score) for item, held in enumerate(best) for score, known, minus in held]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["item", "doc_id", "score"])

    found = rows.mapInArrow(run, "item int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= K)


def search_block(documents: DataFrame, blocks: DataFrame, items: Items) -> DataFrame:
    """item (its number in the block), rank, doc_id and score."""
    highest = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "key"))
    seeds = candidates(blocks, items, None).withColumn("place", highest).where(F.col("place") <= SEEDS)
    rows = keyed(documents)
    # K rows an item at most come back: the last of a full list is the threshold.
    first = scored(rows, seeds, items, None).where(F.col("rank") == K).select("item", "score").collect()
    reached = {r["item"]: r["score"] for r in first}
    thresholds = [reached.get(i, 1) for i in range(len(items.names))]
    return scored(rows, candidates(blocks, items, thresholds), items, thresholds)


def ranked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the ``K`` best documents of each item."""
    spark = documents.sparkSession
    short_batches(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    asked = item_rows(benchmark)
    blocks = stored(index(documents), "slices")
    size = blocks.select(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    total, length = size[0] or 0, size[1] or 0
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    parts = -(-(asked.agg(F.sum("terms")).first()[0] or 0) // BLOCK_TERMS) if total else 0
    for part in range(parts):
        chosen = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item").collect()
        if not chosen:
            continue
        items = Items([(r["item_id"], bytes(r["text"])) for r in chosen])
        items.learn(total, length, frequencies(documents, items.terms))
        found = search_block(documents, blocks, items)
        names = spark.createDataFrame(list(enumerate(items.names)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
