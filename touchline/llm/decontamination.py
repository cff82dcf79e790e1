"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of every text.

Items and texts are normalised alike: A-Z in lower case, words of digits, letters and anything outside ASCII. The words
of the items are numbered, and the automaton reads word numbers. An item's windows are its runs of ``WINDOW`` words; an item
of fewer words is one window. The automaton does not hold the windows, which would repeat each word of an item ten times, but
the item's blocks of ``BLOCK`` words side by side, each word once: every window covers a whole block, so a match of a block is compared
with the words around it in the item, and gives the windows that hold there. Memory follows the text of the benchmark.
Blocks that stand between the same words are kept once, with all their items. Each match is mapped back to words and
to offsets in the text as it was.

Defined cases: a null text has no words and no hits; an empty one the same. Items without a word, and rows of
the benchmark whose text or item_id is null, have no window. An item_id may be of any type that casts to text; on several rows it is
one item with the windows of all of them. Windows that several items share count for each. Repeated documents are scanned and returned
row by row, also under the same or a null doc_id. Texts of any length are scanned whole, in steps of bounded memory. An empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import ALNUM_WORDS, alnum_words, per_row, short_batches, stored, utf8

WINDOW = 10
#: Words of a block. A window of 10 words starts at most 4 words before a block's first word, so it covers that block.
BLOCK = 5
#: Words of one piece of an item; neighbouring pieces share ``WINDOW - 1`` words, so that together they have its windows.
PIECE = 4096
#: Comparisons of a block with its surroundings that are made at a time.
COMPARED = 1 << 16

#: Bytes of item texts and ids in one automaton, about 30 times that in memory. A larger benchmark is scanned in several parts.
MAX_AUTOMATON_BYTES = 8 << 20

PIECES = T.StructType([T.StructField("pieces", T.ArrayType(T.BinaryType()))])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def item_pieces(text: bytes | None) -> list[bytes]:
    """The words of an item between blanks, in pieces that have all its windows."""
    words = alnum_words(text)
    step = PIECE - WINDOW + 1
    return [b" ".join(words[i : i + PIECE]) for i in range(0, max(len(words) - WINDOW + 1, 1), step)] if words else []


def benchmark_parts(spark: SparkSession, benchmark: DataFrame) -> Iterator[list[tuple[bytes, str]]]:
    """Pieces of items with their item, cut into parts that fit one automaton each."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")).where(
        "item_id is not null and text is not null"
    )
    pieces = per_row(rows, "text", lambda: lambda text: (item_pieces(text),), PIECES, ["item_id"])
    pieces = stored(pieces.select("item_id", F.explode("pieces").alias("piece")).distinct(), "pieces")
    total = pieces.agg(F.sum(F.octet_length("piece") + F.octet_length("item_id"))).first()[0] or 0
    parts = -(-total // (MAX_AUTOMATON_BYTES * 9 // 10)) if total > MAX_AUTOMATON_BYTES else 1
    for part in range(parts):
        chosen = pieces.where(F.pmod(F.xxhash64("piece", "item_id"), F.lit(parts)) == part) if parts > 1 else pieces
        yield [(bytes(r["piece"]), r["item_id"]) for r in chosen.collect()]


class Blocks:
    """The automaton over word numbers, and what stands around its blocks."""

    #: Offsets from a block's first word to the words before and behind it that its windows may cover.
    BEFORE = np.arange(-1, BLOCK - WINDOW, -1)[: BLOCK - 1]
    BEHIND = np.arange(BLOCK, WINDOW)

    def __init__(self, pieces: list[tuple[bytes, str]]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        # A pattern is a block or a short item; a place is a pattern between certain words, a row of contexts.
        self.lengths: list[int] = []
        contexts: dict[tuple[int, ...], list[str]] = {}
        items_of: dict[bytes, list[str]] = {}
        for piece, item in pieces:
            items_of.setdefault(piece, []).append(item)
        for piece, items in items_of.items():
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in piece.split(b" "))
            if len(words) < WINDOW:
                contexts.setdefault((self._pattern(words),), []).extend(items)
                continue
            padded = (0,) * (BLOCK - 1) + words + (0,) * BLOCK
            for first in range(0, len(words) - BLOCK + 1, BLOCK):
                pattern = self._pattern(words[first : first + BLOCK])
                around = padded[first : first + BLOCK - 1][::-1] + padded[first + 2 * BLOCK - 1 : first + BLOCK - 1 + WINDOW]
                contexts.setdefault((pattern, *around), []).extend(items)
        if self.lengths:
            self.automaton.make_automaton()
        self._lay_out(contexts)

    def _pattern(self, words: tuple[int, ...]) -> int:
        known = self.automaton.get(words, -1)
        if known < 0:
            known = len(self.lengths)
            self.lengths.append(len(words))
            self.automaton.add_word(words, known)
        return known

    def _lay_out(self, contexts: dict[tuple[int, ...], list[str]]) -> None:
        """Blocks by pattern; short items have a pattern and nothing around it, also those as long as a block."""
        self.whole = {key[0]: items for key, items in contexts.items() if len(key) == 1}
        keys = sorted(key for key in contexts if len(key) > 1)
        table = np.array(keys, np.int32).reshape(len(keys), WINDOW)
        self.items = [contexts[key] for key in keys]
        self.around = table[:, 1:]
        self.starts = np.searchsorted(table[:, 0], np.arange(len(self.lengths) + 1))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window, and the items that have these windows."""
        items: set[str] = set()
        edges = np.zeros(len(words) + 1, np.int64)
        if not words or not self.lengths:
            return edges[:-1] > 0, items
        text = tuple(map(self.numbers.get, words, repeat(0)))
        padded, ends, patterns, met = None, [], [], set()

        def compare() -> None:
            nonlocal padded
            if padded is None:
                # Words of no item are 0 in the text; beyond its ends nothing is like anything.
                padded = np.full(len(text) + 2 * WINDOW, -1, np.int32)
                padded[WINDOW : WINDOW + len(text)] = text
                padded[padded == 0] = -1
            self._compare(padded, np.array(ends), np.array(patterns), edges, met)
            ends.clear()
            patterns.clear()

        waiting = 0
        for end, pattern in self.automaton.iter(text):
            whole = self.whole.get(pattern)
            if whole is not None:
                items.update(whole)
                length = self.lengths[pattern]
                edges[end - length + 1] += 1
                edges[end + 1] -= 1
            places = self.starts[pattern + 1] - self.starts[pattern]
            if places:
                ends.append(end)
                patterns.append(pattern)
                waiting += places
                if waiting > COMPARED:
                    compare()
                    waiting = 0
        if ends:
            compare()
        for place in met:
            items.update(self.items[place])
        return np.cumsum(edges[:-1]) > 0, items

    def _compare(self, padded: np.ndarray, ends: np.ndarray, patterns: np.ndarray, edges: np.ndarray, met: set[int]) -> None:
        counts = self.starts[patterns + 1] - self.starts[patterns]
        first = np.repeat(ends - BLOCK + 1, counts)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(self.starts[patterns], counts) + inside
        at, around = first + WINDOW, self.around[place]
        before = np.logical_and.accumulate(padded[at[:, None] + self.BEFORE] == around[:, : BLOCK - 1], axis=1).sum(axis=1)
        behind = np.logical_and.accumulate(padded[at[:, None] + self.BEHIND] == around[:, BLOCK - 1 :], axis=1).sum(axis=1)
        # The windows that hold here reach from the first like word to the last, if there are enough for one.
        held = before + behind + BLOCK >= WINDOW
        np.add.at(edges, (first - before)[held], 1)
        np.add.at(edges, (first + BLOCK + behind)[held], -1)
        met.update(np.unique(place[held]).tolist())


_built: dict[str, Blocks] = {}


def automaton(shared) -> Blocks:
    """The automaton of a broadcast part, built once in a Python worker."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Blocks(shared.value)
    return _built[shared.id]


class _Part:
    """A broadcast with a number of its own, by which workers know it."""

    count = 0

    def __init__(self, spark: SparkSession, pieces: list) -> None:
        _Part.count += 1
        self.id = f"{spark.sparkContext.applicationId}-{_Part.count}"
        self.held = spark.sparkContext.broadcast(pieces)

    @property
    def value(self) -> list:
        return self.held.value


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as ``[start, end)`` in code points of the text as it was."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(ALNUM_WORDS))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    runs = []
    for first, after in edge.reshape(-1, 2):
        start = len(text[: places[first][0]].decode("utf-8", "replace"))
        inside = text[places[first][0] : places[after - 1][1]].decode("utf-8", "replace")
        runs.append({"start": start, "end": start + len(inside)})
    return runs


def report(text: bytes | None, hit: np.ndarray, items: set[str]) -> tuple:
    ids = ",".join(sorted(items))
    n_hit = int(hit.sum())
    digest = hashlib.sha256(ids.encode()).hexdigest()
    return len(hit), n_hit, len(items), digest, n_hit > 0, spans_of(text, hit) if n_hit else []


def _merged(before: tuple | None, hit: np.ndarray, items: set[str]) -> tuple[np.ndarray, set[str]]:
    if before is None:
        return hit, items
    packed, ids = before
    old = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(hit)).astype(bool) if len(hit) else hit
    return hit | old, items | set(ids)


def scanned(documents: DataFrame, benchmark: DataFrame, keep: list[str], output) -> DataFrame:
    """``output`` is called in each task with batches of ``keep`` columns, their texts, hits and items.

    Each part of the benchmark is one scan; the hits of earlier parts travel with the rows, through a stored table.
    """
    spark = documents.sparkSession
    short_batches(spark)
    rows = documents.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], utf8().alias("text"))
    kept = rows.columns[:-1]
    state = [("hits", pa.binary()), ("items", pa.list_(pa.string()))]
    pending = None
    for pieces in benchmark_parts(spark, benchmark):
        if pending is not None:
            rows = stored(rows.mapInArrow(_pass(pending, kept, state), _with_state(rows, kept)), "hits")
        pending = _Part(spark, pieces)
    schema, emit = output
    return rows.mapInArrow(_last(pending, kept, emit), schema)


def _with_state(rows: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([*rows.select(*kept, "text").schema.fields, *FOUND.fields[1:]])


def _scan(part: _Part, batch: pa.RecordBatch) -> Iterator[tuple]:
    made = automaton(part)
    texts = batch.column("text").to_pylist()
    before = [None] * len(texts)
    if "hits" in batch.schema.names:
        before = list(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True))
    for text, old in zip(texts, before, strict=True):
        yield text, *_merged(old, *made.scan(alnum_words(text)))


def _pass(part: _Part, kept: list[str], state: list):
    def run(batches):
        for batch in batches:
            found = [(np.packbits(hit).tobytes(), sorted(items)) for _, hit, items in _scan(part, batch)]
            made = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(state)]
            columns = [batch.column(k) for k in [*kept, "text"]] + made
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", *[n for n, _ in state]])

    return run


def _last(part: _Part, kept: list[str], emit):
    def run(batches):
        for batch in batches:
            yield emit(batch, kept, list(_scan(part, batch)))

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items met, their digest, whether contaminated, and the hit spans."""

    def emit(batch, kept, found):
        rows = [report(*f) for f in found]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(kept[0]), *made], [id_column, *REPORT.names])

    schema = T.StructType([documents.schema[id_column], *REPORT.fields])
    return scanned(documents, benchmark, [id_column], (schema, emit))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    names = documents.columns

    def emit(batch, kept, found):
        clean = pa.array([not hit.any() for _, hit, _ in found], pa.bool_())
        rows = pa.RecordBatch.from_arrays([batch.column(k) for k in kept], names)
        return rows.filter(clean)

    return scanned(documents, benchmark, names, (documents.schema, emit))
