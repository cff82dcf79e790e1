"""LM scoring by subword lattices: the probability of a text summed over all its segmentations.

A word's lattice has the pieces of an existing vocabulary as arcs, weighted by that vocabulary's own scores (fitted to the training
words in ``ROUNDS`` rounds; the pieces stay), and is summed by a forward recursion in log space; characters without a piece fall back to bytes. No piece begins inside one word and ends in the next, so a
text's lattice is the chain of its words' lattices, and each distinct word is summed once. What the training texts add are arcs
over whole words, one lattice for each language class: with ``L(w)`` the sum over pieces,

    background(w) = (c(w) + once * L(w)) / (N + once)
    P_k(w) = (c_k(w) + once_k * background(w)) / (N_k + once_k)

where ``once`` counts words seen once. The text's probability is the mixture of its probabilities in the classes, so
no input but the text itself enters a score. ``score`` is its log10, the end of the text included.

Words are counted in the tasks and summed by word; the words that make up most of all tokens, ``HOT_WORDS`` at most, are held by every task,
the others meet their counts in a join, one row for each document and rare word.

Defined cases: a null text counts as empty, which is an end alone. A null doc_id has the remainder of the empty text. A null lang is a class. Repeated rows are scored row by
row and count each. Without training texts (also an empty table) all counts are 0 and the pieces alone decide. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import id_remainder, short_batches, spaced_words, stored, utf8

MODULUS, HELD_OUT = 7, 2
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Languages with a class of their own; the rest share one.
LANGUAGES = 6
HOT_WORDS = 300_000
#: Distinct words that a task gathers before it hands them on.
FLUSH_WORDS = 400_000
#: Rounds of fitting the pieces' weights to the training words.
ROUNDS = 2

# -- the vocabulary


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their log weights (natural), in order, that of any single byte, and that of the end of a text."""

    pieces: tuple[str, ...]
    weights: np.ndarray
    byte: float
    end: float


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read on the driver. Scores of unigram files are log probabilities; the ranks in merge files become 1 / (rank + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scored = {model.id_to_piece(i): model.get_score(i) for i in usable}
    scored = {p: s for p, s in scored.items() if s > -1e8 and "▁" not in p[1:]}
    ranks = all(float(s).is_integer() for s in scored.values())
    weights = {p: 1 / (10 - s) if ranks else math.exp(s) for p, s in scored.items()}
    # A byte and the end are worth as much as the last pieces.
    low = min(weights.values())
    return _normal(tuple(weights), np.array(list(weights.values())), low, low)


def _normal(pieces: tuple[str, ...], weights: np.ndarray, byte: float, end: float) -> Vocabulary:
    total = weights.sum() + 256 * byte + end
    # The end takes the place of a piece that begins a word.
    begins = weights[[p.startswith("▁") for p in pieces]].sum() + end
    return Vocabulary(pieces, np.log(weights / total), math.log(byte / total), math.log(end / begins))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


class Lattice:
    """Sums words over all segmentations, many words of one length at once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.byte = vocab.byte
        self.longest = max(map(len, vocab.pieces), default=1)
        self.powers = np.cumprod(np.full(self.longest, _BASE, np.uint64))
        keys = np.array([_rolled(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in vocab.pieces], np.uint64)
        order = np.argsort(keys)
        self.order, self.keys, self.values = order, keys[order], vocab.weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.keys)] = True
        self.alone = {p for p in vocab.pieces if len(p) == 1}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(44)).astype(np.int64)

    def sums(self, words: list[str]) -> np.ndarray:
        """log probability (natural) of each word, the mark of its beginning included."""
        out = np.empty(len(words))
        for places, codes in self._by_length(words):
            out[places] = self._forward(codes)[0][:, -1]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece, and last any byte, is expected in segmentations of the words."""
        out = np.zeros(len(self.values) + 1)
        for _, codes in self._by_length(words):
            alpha, arcs = self._forward(codes)
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = 0.0
            for at, start, end, place, weight in reversed(arcs):
                beta[at, start] = np.logaddexp(beta[at, start], weight + beta[at, end])
                share = np.exp(alpha[at, start] + weight + beta[at, end] - alpha[at, -1])
                out += np.bincount(place, share, len(out))
        return out

    @staticmethod
    def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word), []).append(at)
        for length, places in by_length.items():
            text = "".join("▁" + words[at] for at in places)
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(places), length + 1)
            yield places, codes.astype(np.uint64)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Summed log weights up to each place, and the arcs: rows, start, end, pieces, weights."""
        count, length = codes.shape
        rolled = _rolled(codes)
        alpha = np.full((count, length + 1), -np.inf)
        alpha[:, 0] = 0.0
        arcs = []
        for j in range(1, length + 1):
            for size in range(1, min(self.longest, j) + 1):
                keys = rolled[:, j] - rolled[:, j - size] * self.powers[size - 1]
                at = np.flatnonzero(self.maybe[self._slot(keys)])
                if len(at):
                    place = np.searchsorted(self.keys, keys[at])
                    place[place == len(self.keys)] = 0
                    same = self.keys[place] == keys[at]
                    at, place = at[same], place[same]
                    arcs.append((at, j - size, j, place, self.values[place]))
                    alpha[at, j] = np.logaddexp(alpha[at, j], alpha[at, j - size] + self.values[place])
            for code in np.unique(codes[:, j - 1]):
                if chr(code) not in self.alone:
                    at = np.flatnonzero(codes[:, j - 1] == code)
                    weight = self.byte * len(chr(code).encode("utf-8", "replace"))
                    arcs.append((at, j - 1, j, np.full(len(at), len(self.values)), np.full(len(at), weight)))
                    alpha[at, j] = np.logaddexp(alpha[at, j], alpha[at, j - 1] + weight)
        return alpha, arcs


def fitted(counts: DataFrame, vocab: Vocabulary, rounds: int) -> Vocabulary:
    """Weights after so many rounds of expectation and maximisation over the distinct training words.

    The vocabulary stays as it is, and its own scores are where the rounds begin. Each distinct word counts once: the pieces speak for words that have
    not been seen, and those resemble rare words rather than frequent ones. Expected counts are summed by piece.
    """
    spark = counts.sparkSession
    names = [n for n in counts.columns if n != "word"]
    seen = counts.where(sum((F.col(n) for n in names), F.lit(0)) > 0).select("word")
    first = np.exp(vocab.weights)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(vocab)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(held.value)
            total = np.zeros(len(lattice.values) + 1)
            for batch in batches:
                total += lattice.expected([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()])
            places = np.append(lattice.order, len(lattice.order))
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(places[some]), pa.array(total[some])], ["place", "n"])

        found = seen.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(len(vocab.pieces) + 1)
        expected[found["place"].to_numpy()] = found["n"].to_numpy()
        if not expected.sum():
            break
        # A hundredth of the vocabulary's own weights stays, so no piece is ruled out.
        kept = 0.01 * expected.sum()
        vocab = _normal(vocab.pieces, expected[:-1] + kept * first, (expected[-1] + kept * first.min()) / 256, kept * first.min())
    return vocab


# -- counting


def _classes(documents: DataFrame) -> list:
    """The most frequent languages of the training texts, ties by name."""
    counted = documents.where(id_remainder(MODULUS) != HELD_OUT).groupBy("lang").agg(F.count("*").alias("n"))
    return [r["lang"] for r in counted.orderBy(F.desc("n"), F.col("lang").asc_nulls_last()).limit(LANGUAGES).collect()]


def _class_of(languages: list):
    """Place of a row's class: its language's place, or that of all others."""
    place = F.lit(len(languages))
    for k, lang in enumerate(languages):
        place = F.when(F.col("lang").eqNullSafe(F.lit(lang)), k).otherwise(place)
    return place.cast("int")


def word_counts(documents: DataFrame, languages: list) -> DataFrame:
    """word and its training counts c0, c1, ... by class; 0 for words of held-out texts only."""
    classes = len(languages) + 1
    rows = documents.select(
        utf8().alias("text"), _class_of(languages).alias("cls"), (id_remainder(MODULUS) != HELD_OUT).alias("train")
    )

    def handed(held: list[Counter]) -> Iterator[pa.RecordBatch]:
        for cls, counter in enumerate(held):
            words, counts = list(counter), list(counter.values())
            for at in range(0, len(words), 50_000):
                part = slice(at, at + 50_000)
                columns = [pa.array(words[part], pa.binary()), pa.array([cls] * len(words[part]), pa.int32()), pa.array(counts[part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "cls", "n"])
            counter.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(classes)]
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("text", "cls", "train")]
            for text, cls, train in zip(*values, strict=True):
                if train:
                    held[cls].update(spaced_words(text))
                else:
                    for word in set(spaced_words(text)):
                        held[cls][word] += 0
            if sum(map(len, held)) > FLUSH_WORDS:
                yield from handed(held)
        yield from handed(held)

    counted = rows.mapInArrow(run, "word binary, cls int, n long")
    sums = [F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    return counted.groupBy("word").agg(*sums)


@dataclass(frozen=True)
class Totals:
    """Of the training texts: tokens, distinct tokens, words seen once, and by class tokens, words once, texts."""

    tokens: int
    distinct: int
    once: int
    class_tokens: list[int]
    class_once: list[int]
    class_texts: list[int]


def totals(counts: DataFrame, documents: DataFrame, languages: list) -> Totals:
    classes = range(len(languages) + 1)
    c = sum((F.col(f"c{k}") for k in classes), F.lit(0))
    row = counts.agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("n"),
        F.count_if(c > 0).alias("v"),
        F.count_if(c == 1).alias("once"),
        *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"n{k}") for k in classes],
        *[F.count_if(F.col(f"c{k}") == 1).alias(f"once{k}") for k in classes],
    ).first()
    texts = documents.where(id_remainder(MODULUS) != HELD_OUT).groupBy(_class_of(languages).alias("k")).count()
    by_class = {r["k"]: r["count"] for r in texts.collect()}
    ends = [by_class.get(k, 0) for k in classes]
    return Totals(
        row["n"] + sum(ends),
        row["v"] + (sum(ends) > 0),
        max(row["once"], 1),
        [row[f"n{k}"] + ends[k] for k in classes],
        [max(row[f"once{k}"], 1) for k in classes],
        ends,
    )


def _log_p(c, c_k, pieces, t: Totals, k: int):
    """log10 of P_k; works on numbers and on columns."""
    background = (c + t.once * pieces) / (t.tokens + t.once)
    return (c_k + t.class_once[k] * background) / (t.class_tokens[k] + t.class_once[k])


def word_table(counts: DataFrame, vocab: Vocabulary, t: Totals) -> DataFrame:
    """word, c, and p0, p1, ... (log10 probability in each class)."""
    classes = range(len(t.class_texts))
    held = counts.sparkSession.sparkContext.broadcast(vocab)
    names = [f"c{k}" for k in classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(held.value)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            # A very unlikely word underflows to 0 as a probability, so logarithms are combined.
            pieces = lattice.sums(words)
            by_class = [batch.column(n).to_numpy().astype(np.float64) for n in names]
            c = sum(by_class, np.zeros(len(words)))
            with np.errstate(divide="ignore"):
                background = np.logaddexp(np.log(c), np.log(t.once) + pieces) - np.log(t.tokens + t.once)
                logs = [
                    np.logaddexp(np.log(by_class[k]), np.log(t.class_once[k]) + background)
                    - np.log(t.class_tokens[k] + t.class_once[k])
                    for k in classes
                ]
            columns = [batch.column("word"), pa.array(c.astype(np.int64))]
            columns += [pa.array((x / np.log(10)).astype(np.float32)) for x in logs]
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", *[f"p{k}" for k in classes]])

    fields = ", ".join(f"p{k} float" for k in classes)
    return stored(counts.mapInArrow(run, f"word binary, c long, {fields}"), "words")


def hot_words(words: DataFrame, classes: range) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The most frequent words, ``HOT_WORDS`` at most: whole steps of frequency from the top."""
    step = F.floor(F.log2("c") * 16)
    sizes = {r["s"]: r["count"] for r in words.where("c > 0").groupBy(step.alias("s")).count().collect()}
    least, total = None, 0
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > HOT_WORDS:
            break
        total, least = total + sizes[s], s
    if least is None:
        return [], np.empty(0, np.int64), np.empty((0, len(classes)), np.float32)
    table = words.where((F.col("c") > 0) & (step >= least)).toArrow()
    probabilities = np.stack([table[f"p{k}"].to_numpy() for k in classes], axis=1)
    return table["word"].to_pylist(), table["c"].to_numpy(), probabilities


# -- scoring


def scores(documents: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    short_batches(spark)
    vocab = vocab or vocabulary()
    languages = _classes(documents)
    classes = range(len(languages) + 1)
    counts = stored(word_counts(documents, languages), "counts")
    t = totals(counts, documents, languages)
    # Words are short: the lattices of many are summed together.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    vocab = fitted(counts, vocab, ROUNDS)
    words = word_table(counts, vocab, t)
    short_batches(spark)
    held = spark.sparkContext.broadcast(hot_words(words, classes))
    ends = sum(t.class_texts)
    end_p = [math.log10(_log_p(ends, t.class_texts[k], math.exp(vocab.end), t, k)) for k in classes]
    rows = documents.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        utf8().alias("text"),
    )
    sums = ["tokens", "known", "base", *[f"s{k}" for k in classes]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, c, logs = held.value
        place = {w: i for i, w in enumerate(listed)}
        base = np.log10(c + 1.0)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("rid", "doc_id", "word", "n", *sums)}
            ids = [batch.column(x).to_pylist() for x in ("rid", "doc_id", "text")]
            for rid, doc_id, text in zip(*ids, strict=True):
                tokens = spaced_words(text)
                at = np.fromiter((place.get(w, -1) for w in tokens), np.int64, len(tokens))
                hot = at[at >= 0]
                rare = Counter(tokens[i] for i in np.flatnonzero(at < 0))
                values = [len(tokens) + 1, len(hot) + (ends > 0), base[hot].sum() + math.log10(ends + 1)]
                values += (logs[hot].sum(axis=0, dtype=np.float64) + end_p).tolist() if len(hot) else end_p
                # A word has no blank: this key meets no word, and is another for each text.
                out["rid"] += [rid] * (1 + len(rare))
                out["doc_id"] += [doc_id] + [None] * len(rare)
                out["word"] += [b" %d" % rid, *rare]
                out["n"] += [0, *rare.values()]
                for name, value in zip(sums, values, strict=True):
                    out[name] += [float(value)] + [0.0] * len(rare)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()] + [pa.float64()] * len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    fields = ", ".join(f"{n} double" for n in sums)
    parts = rows.mapInArrow(run, f"rid long, doc_id long, word binary, n long, {fields}")
    parts = parts.join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    summed = parts.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tokens").cast("long").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).cast("long").alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.log10(c + 1)).alias("base"),
        *[F.sum(F.col(f"s{k}") + F.coalesce(F.col("n") * F.col(f"p{k}"), F.lit(0.0))).alias(f"s{k}") for k in classes],
    )
    # A class without training texts has no share in the mixture, unless there are none at all.
    shares = [(k, n) for k, n in enumerate(t.class_texts) if n] or [(0, 1)]
    logs = [F.col(f"s{k}") + math.log10(n / sum(m for _, m in shares)) for k, n in shares]
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    mixed = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in logs), F.lit(0.0)))
    floor = math.log10(t.tokens + 1 * (t.distinct + 1))
    return summed.select(
        "doc_id",
        (id_remainder(MODULUS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(t.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * floor).alias("base_score"),
        mixed.alias("score"),
    )
