"""Removal of passages that occur elsewhere, from suffix arrays of the pieces of text that can hold them.

A passage is a string of ``WINDOW`` bytes; one that starts at two places of the corpus is repeated, and all bytes that it covers are
removed. Equal windows have equal least hashes of their ``k``-byte strings, so each text is cut into pieces, the runs of window
starts of one least hash with the bytes that their windows cover, and only pieces whose hash (key) occurs again, in them or in others, are
followed up. Pieces alike in key and content are one class with a count, stored once. Where all classes of a key occur twice or
more, each is repeated from end to end. The classes of any other key meet in one task,
which builds their suffix array (``suffixes``: grouping by Lyndon prefixes, then emitting group by group); neighbours in it that agree in a whole
window are compared byte by byte, and windows counted twice or more are repeated.

A key whose classes number more than ``GROUP_BYTES`` together is dealt again by longer strings, ``LEVELS`` in turn, until at
last a key is one window, so no number of different surroundings of a common passage ends in one task. What is found in a
class holds for every place where it occurs.

Rows are told apart by a digest of doc_id and text. Defined cases: a null text is empty; texts shorter than a window stay whole, and
nothing is counted in them; matches never cross documents. Repeated rows, equal texts and a repetition within one text all
count as other places. An empty table gives no rows. Long texts are cut into pieces in stretches of ``STRETCH`` window starts, so
every window is seen. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import id_text, short_batches, stored, utf8
from touchline.llm.suffixes import suffix_arrays

WINDOW = 200
#: Lengths of the strings by whose least hash windows are dealt, as shares of the window.
LEVELS = (0.32, 0.75, 0.95, 1.0)
#: Window starts that are hashed in one go, and those after which a run of periodic text is cut.
STRETCH, PIECE = 1 << 20, 64
#: Bytes of the classes of one key that are put into one suffix array, and of all arrays that are built in step.
GROUP_BYTES, BATCH_BYTES = 16_384, 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Hashes:
    """Hashes of all strings of ``k`` bytes in an array of bytes, alike in every process."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, text: np.ndarray, k: int) -> np.ndarray:
        if len(self.up) <= len(text):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _BASE_INVERSE)]))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_LETTER[text] * self.down[: len(text)], out=sums[1:])
        return _mixed((sums[k:] - sums[:-k]) * self.up[: len(text) - k + 1])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).reshape(-1)
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def pieces(texts: list[bytes], window: int, k: int, hashes: Hashes) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns text, begin, end, key and again of all pieces: the windows that begin from ``begin`` to ``end - window`` share ``key``.

    ``again`` tells whether the string of that hash occurs twice, as it must for a window to occur twice in a piece. In such
    periodic text a long run is cut behind the string, so that its pieces are alike.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    firsts = np.cumsum(lengths) - lengths
    for begin in range(0, max(0, len(whole) - window + 1), STRETCH):
        part = whole[begin : begin + STRETCH + window - 1]
        values = hashes.of(part, k)
        keys = least(values, window - k + 1)
        starts = np.arange(begin, begin + len(keys))
        text = np.searchsorted(firsts, starts, "right") - 1
        inside = starts + window <= firsts[text] + lengths[text]
        starts, text, keys = starts[inside], text[inside], keys[inside]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        run = np.diff(np.append(heads, len(starts)))
        spans = run + window - k
        offsets = np.cumsum(spans) - spans
        held = values[np.arange(spans.sum()) + np.repeat(starts[heads] - begin - offsets, spans)] == np.repeat(keys[heads], spans)
        again = np.add.reduceat(held, offsets, dtype=np.int64) > 1
        cuts = []
        for r in np.flatnonzero(again & (run > PIECE)):
            last = 0
            for at in np.flatnonzero(held[offsets[r] : offsets[r] + run[r] - 1]) + 1:
                if at - last >= PIECE:
                    cuts.append(heads[r] + at)
                    last = at
        if cuts:
            of = np.repeat(again, run)
            heads = np.sort(np.concatenate([heads, cuts]))
            run, again = np.diff(np.append(heads, len(starts))), of[heads]
        own = starts[heads] - firsts[text[heads]]
        yield text[heads], own, own + run + window - 1, keys[heads].view(np.int64), again


def content_hash(content: bytes) -> int:
    return int.from_bytes(blake2b(content, digest_size=8).digest(), "big", signed=True)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


#: Texts travel packed.
def _packed(text: bytes) -> bytes:
    import zstandard

    return zstandard.compress(text, 3)


def _unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(packed)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a digest of both by which rows are joined."""
    text = F.coalesce(utf8(), F.lit(b""))
    digest = F.unhex(F.md5(F.concat(id_text().cast("binary"), F.lit(b"|"), text)))
    return documents.select("doc_id", text.alias("text"), digest.alias("uid"))


def text_pieces(rows: DataFrame, window: int) -> DataFrame:
    """uid, begin, end, key, content hash and again of every piece of every text."""
    k = max(1, int(window * LEVELS[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            uids, texts = batch.column("uid"), batch.column("text").to_pylist()
            for text, begin, end, key, again in pieces(texts, window, k, hashes):
                held = [content_hash(texts[t][b:e]) for t, b, e in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True)]
                columns = [uids.take(pa.array(text)), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(key), pa.array(held, pa.int64()), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "begin", "end", "key", "hash", "again"])

    rows = rows.where(F.octet_length("text") >= window).select("uid", "text")
    return rows.mapInArrow(run, "uid binary, begin int, end int, key long, hash long, again boolean")


def repeated_pieces(found: DataFrame) -> DataFrame:
    """The pieces whose key occurs more than once, in another piece or in one."""
    times = F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("times")
    return found.join(found.groupBy("key").agg(times).where("times > 1").select("key"), "key", "left_semi").drop("again")


def with_size(classes: DataFrame, bytes_of: str) -> DataFrame:
    """Adds ``group_bytes``, the bytes of all classes of a key, and ``least_n``, the least count of them."""
    sizes = classes.groupBy("key").agg(F.sum(bytes_of).alias("group_bytes"), F.min("n").alias("least_n"))
    return classes.join(sizes, "key")


def contents(classes: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The classes (key, hash, n, group_bytes and a place: uid, begin, end) with their content."""
    wanted = classes.groupBy("uid").agg(F.collect_list(F.struct("begin", "end", "key", "hash", "n", "group_bytes")).alias("asked"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_packed(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(texts, pa.binary())], ["uid", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hash", "n", "group_bytes", "content"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            found = []
            for packed, asked in zip(batch.column("packed").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                text = _unpacked(packed)
                found += [(a["key"], a["hash"], a["n"], a["group_bytes"], text[a["begin"] : a["end"]]) for a in asked]
            yield _batch(found, names, kinds)

    texts = rows.where(F.octet_length("text") >= window).select("uid", "text").mapInArrow(pack, "uid binary, packed binary")
    # Rows alike in doc_id and text are one here.
    texts = texts.groupBy("uid").agg(F.first("packed").alias("packed"))
    return texts.join(wanted, "uid").mapInArrow(cut, "key long, hash long, n long, group_bytes long, content binary")


def repeated_windows(texts: list[bytes], counts: list[int], groups: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each text the stretches covered by windows that occur twice or more in the texts of its group.

    Texts of a group are neighbours. A text counts ``counts`` times.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    # A zero ends each text; letters are one more than their bytes.
    letters = np.zeros(int(lengths.sum()) + len(texts), np.int16)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(letters), bool)
    inside[firsts + lengths] = False
    letters[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    heads = np.flatnonzero(np.diff(np.array(groups), prepend=groups[0] - 1))
    begins = firsts[heads]
    order = suffix_arrays(letters, begins, np.diff(np.append(begins, len(letters))))
    of = np.repeat(np.arange(len(texts)), lengths + 1)
    place = np.arange(len(letters))
    room = place + window <= (firsts + lengths)[of]
    order = order[room[order]]
    if not len(order):
        return [[] for _ in texts]
    # Neighbours are compared eight bytes at a time, the last eight once more if the window is no multiple.
    padded = np.zeros(len(letters) + 8, np.uint8)
    padded[: len(letters)] = np.maximum(letters - 1, 0)
    eight = np.ndarray(len(letters), "<u8", padded, strides=(1,))
    group_of = np.array(groups)[of]
    same = np.flatnonzero(group_of[order[1:]] == group_of[order[:-1]])
    for at in [*range(0, window - 7, 8), window - 8] if window >= 8 else []:
        same = same[eight[order[same] + at] == eight[order[same + 1] + at]]
    if window < 8:
        for at in range(window):
            same = same[padded[order[same] + at] == padded[order[same + 1] + at]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    kind = np.cumsum(new) - 1
    times = np.bincount(kind, np.array(counts, np.float64)[of[order]])
    hit = np.sort(order[times[kind] >= 2])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(hit):
        apart = np.ones(len(hit), bool)
        apart[1:] = (hit[1:] > hit[:-1] + window) | (of[hit[1:]] != of[hit[:-1]])
        lows = hit[apart]
        highs = hit[np.append(np.flatnonzero(apart)[1:] - 1, len(hit) - 1)] + window
        text = of[lows]
        for t, low, high in zip(text.tolist(), (lows - firsts[text]).tolist(), (highs - firsts[text]).tolist(), strict=True):
            out[t].append((low, high))
    return out


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def searched(classes: DataFrame, window: int) -> DataFrame:
    """key, hash and spans of the classes that hold repeated windows. All classes of a key must be given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            spans = repeated_windows([r[3] for r in held], [r[2] for r in held], [r[0] for r in held], window)
            rows = [(r[0], r[1], [{"begin": b, "end": e} for b, e in s]) for r, s in zip(held, spans, strict=True) if s]
            return _batch(rows, ["key", "hash", "spans"], [pa.int64(), pa.int64(), SPANS])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "n", "content")), strict=True):
                if size >= BATCH_BYTES and held[-1][0] != row[0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield found()

    # In order of size, so that groups built in step are of like size.
    dealt = classes.select("key", "hash", "n", "content", "group_bytes").repartition("key").sortWithinPartitions("group_bytes", "key")
    schema = "key long, hash long, spans array<struct<begin: int, end: int>>"
    return dealt.select("key", "hash", "n", "content").mapInArrow(run, schema)


def dealt_again(classes: DataFrame, window: int, share: float) -> DataFrame:
    """The classes cut into pieces by longer strings: in_key, in_hash, shift, n, key, hash, content."""
    k = int(window * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        names = ["in_key", "in_hash", "shift", "n", "key", "hash", "content"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "n", "content")), strict=True))
            found = []
            for columns in pieces([r[3] for r in rows], window, k, hashes):
                for t, begin, end, key, _ in zip(*(c.tolist() for c in columns), strict=True):
                    content = rows[t][3][begin:end]
                    found.append((rows[t][0], rows[t][1], begin, rows[t][2], key, content_hash(content), content))
            yield _batch(found, names, kinds)

    schema = "in_key long, in_hash long, shift int, n long, key long, hash long, content binary"
    return classes.select("key", "hash", "n", "content").mapInArrow(run, schema)


def class_spans(classes: DataFrame, window: int, level: int = 1) -> DataFrame:
    """key, hash and spans of classes (key, hash, n, content, group_bytes), keys of any size included."""
    light = searched(classes.where(F.col("group_bytes") <= GROUP_BYTES), window)
    heavy = classes.where(F.col("group_bytes") > GROUP_BYTES)
    if level >= len(LEVELS) or heavy.isEmpty():
        return light if level < len(LEVELS) else searched(classes, window)
    parts = stored(dealt_again(heavy, window, LEVELS[level]), "parts")
    again = parts.groupBy("key", "hash").agg(F.sum("n").alias("n"), F.first("content").alias("content"))
    again = stored(with_size(again.withColumn("bytes", F.octet_length("content")), "bytes").drop("bytes", "least_n"), "classes")
    inner = class_spans(again, window, level + 1)
    places = parts.select("in_key", "in_hash", "shift", "key", "hash").join(inner, ["key", "hash"])
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("shift")).alias("begin"), (s["end"] + F.col("shift")).alias("end")))
    back = places.select(F.col("in_key").alias("key"), F.col("in_hash").alias("hash"), moved.alias("spans"))
    back = back.groupBy("key", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return light.unionByName(back)


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """uid and the spans (they may overlap) of its text that are covered by repeated windows."""
    places = stored(repeated_pieces(stored(text_pieces(rows, window), "all-pieces")), "pieces")
    classes = places.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min(F.struct("uid", "begin", "end")).alias("at"))
    classes = classes.select("key", "hash", "n", "at.*").withColumn("bytes", F.col("end") - F.col("begin"))
    classes = stored(with_size(classes, "bytes"), "classes")
    # Where all classes of a key occur twice or more, each is repeated as a whole and nothing is left to search.
    span = F.struct(F.lit(0).alias("begin"), F.col("bytes").alias("end"))
    whole = classes.where("least_n > 1").select("key", "hash", F.array(span).alias("spans"))
    with_content = stored(contents(classes.where("least_n = 1"), rows, window), "contents")
    spans = class_spans(with_content, window).unionByName(whole)
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("begin")).alias("begin"), (s["end"] + F.col("begin")).alias("end")))
    back = places.join(spans, ["key", "hash"]).select("uid", moved.alias("spans"))
    return back.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of the merged spans."""
    cuts = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, the removed spans of the text's bytes (maximal, in order), n_bytes, and the bytes that are kept."""
    return _cut(documents, window, "kept binary", lambda text, spans: (kept(text, spans),))


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = _cut(documents, window, "kept_sha256 string", lambda text, spans: (sha256(kept(text, spans)).hexdigest(),))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def _cut(documents: DataFrame, window: int, column: str, made) -> DataFrame:
    if window < 1:
        raise ValueError("a window has at least one byte")
    spark = documents.sparkSession
    short_batches(spark)
    rows = keyed(documents)
    spans = stored(repeated_spans(rows, window), "spans")
    id_kind = documents.schema["doc_id"].dataType.simpleString()
    name, kind = column.split()
    out_kind = {"binary": pa.binary(), "string": pa.string()}[kind]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([_packed(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), texts], ["doc_id", "uid", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_unpacked(p) for p in batch.column("packed").to_pylist()]
            cuts = [merged([(s["begin"], s["end"]) for s in found or []]) for found in batch.column("spans").to_pylist()]
            columns = [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"begin": b, "end": e} for b, e in cut] for cut in cuts], SPANS),
                pa.array([made(t, cut)[0] for t, cut in zip(texts, cuts, strict=True)], out_kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", name])

    packed = rows.mapInArrow(pack, f"doc_id {id_kind}, uid binary, packed binary")
    joined = packed.join(spans, "uid", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, f"doc_id {id_kind}, n_bytes long, spans array<struct<begin: int, end: int>>, {column}")
