"""Ranked search, removal of repeated passages and spelling variants against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import bitsliced, repeats, spelling
from touchline.llm.suffixes import suffix_arrays

# Names that the operators use or return, as extra columns.
DOCS = "doc_id long, text string, key string, uid string, item string, score string, rank string, n string, word string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [lower(t) for t in TERM.findall(text or "")]


def brute_ranking(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    total = sum(1 for _, c in docs if c)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in docs:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + ((25 * n * total) // length)
                    score += weight * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (minus, unknown, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, None if unknown else doc_id, -minus))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i % 4001}" for i in range(30_000))


@pytest.mark.parametrize("budget", [bitsliced.BLOCK_TERMS, 12])
def test_ranking_equals_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(bitsliced, "BLOCK_TERMS", budget)
    monkeypatch.setattr(bitsliced, "K", 5)
    monkeypatch.setattr(bitsliced, "SEEDS", 6)
    monkeypatch.setattr(bitsliced, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)] + ["Été", "été", "ÉTÉ", "x9", "X9"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 8, 40])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .,! "), (203, LONG), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, rows[7][1])]
    rows += [(300 + i, "w1 w2 same words") for i in range(9)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(8)]
    items += [(90, None), (91, ""), (92, "nowhere"), (None, "w1 w2"), (93, "w1 w2 w1 same"), (93, "w1 w2 w1 same"), (94, "w3999 " * 3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = bitsliced.ranked(docs(spark, rows), benchmark).collect()
    assert sorted(map(tuple, found), key=repr) == brute_ranking(rows, items, 5)


def test_few_documents_are_scored_where_one_stands_out(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(pool, k=60))) for i in range(400)]
    table = docs(spark, rows + [(1000 + i, rows[5][1] + f" w{i}") for i in range(25)])
    items = bitsliced.Items([(1, rows[5][1].encode())])
    blocks = bitsliced.index(table).cache()
    items.learn(425, 425 * 60, bitsliced.frequencies(table, items.terms))
    best = bitsliced.scored(bitsliced.keyed(table), bitsliced.candidates(blocks, items, None), items, None)
    least = best.where("rank = 20").first()["score"]
    left = bitsliced.candidates(blocks, items, [least]).count()
    assert 20 <= left <= 60


def test_search_in_empty_tables_and_by_text_ids(spark):
    benchmark = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert bitsliced.ranked(docs(spark, []), benchmark).collect() == []
    assert bitsliced.ranked(docs(spark, [(1, "w1")]), benchmark.limit(0)).collect() == []
    assert [(r["item_id"], r["doc_id"]) for r in bitsliced.ranked(docs(spark, [(1, "w1"), (2, "w2")]), benchmark).collect()] == [("a", 1)]


# -- repeated passages


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(400):
        blocks = [b""]
        for _ in range(rng.randint(1, 6)):
            part = bytes(rng.choices(b"abc", k=rng.randint(1, 4)))
            blocks.append(part * rng.randint(0, 9) + bytes(rng.choices(b"abcd"[: rng.randint(1, 4)], k=rng.randint(0, 40))))
        sizes = np.array([len(b) for b in blocks])
        begins = np.cumsum(sizes) - sizes
        got = suffix_arrays(np.frombuffer(b"".join(blocks), np.uint8).astype(np.int16), begins, sizes)
        want = [s + i for b, s in zip(blocks, begins, strict=True) for i in sorted(range(len(b)), key=lambda i, b=b: b[i:])]
        assert list(got) == want


def brute_repeats(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[p : p + window] for _, b in texts for p in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if times[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def passages(rng, n=60):
    letters = "abcdefgh é"
    make = lambda k: "".join(rng.choices(letters, k=k))
    common = [make(k) for k in (19, 20, 21, 45, 80, 200)]
    rows = [(i, "".join(rng.choice([make(rng.randint(0, 30)), rng.choice(common)]) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, "ab" * 40), (103, "z" * 300), (104, "short"), (None, common[3]), (None, common[3])]
    return rows + [rows[3], rows[3], (105, make(20_000)), (106, "".join(make(9) + common[4] for _ in range(30)))]


@pytest.mark.parametrize("group_bytes", [repeats.GROUP_BYTES, 100])
def test_repeats_equal_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(repeats, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    monkeypatch.setattr(repeats, "PIECE", 8)
    rows = passages(random.Random(8))
    found = repeats.digests(docs(spark, rows), window=20).collect()
    assert sorted(map(tuple, found), key=repr) == brute_repeats(rows, 20)


def test_one_passage_in_many_surroundings_is_dealt_again(spark, monkeypatch):
    rng = random.Random(9)
    make = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    common = make(60)
    rows = [(i, make(50) + common + make(50)) for i in range(300)]
    monkeypatch.setattr(repeats, "GROUP_BYTES", 2000)
    sizes = []
    searched = repeats.searched
    monkeypatch.setattr(repeats, "searched", lambda c, w: sizes.append(c.agg({"group_bytes": "max"}).first()[0] or 0) or searched(c, w))
    found = repeats.digests(docs(spark, rows), window=40).collect()
    assert sorted(map(tuple, found), key=repr) == brute_repeats(rows, 40)
    assert max(sizes) <= 2000


def test_classes_that_all_occur_twice_are_not_searched(spark, monkeypatch):
    rng = random.Random(12)
    copied, shared, own = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(0, copied), (1, copied), (2, None), (3, shared + own), (4, own[:200] + shared)]
    asked = []
    contents = repeats.contents
    monkeypatch.setattr(repeats, "contents", lambda c, *rest: asked.append(c.collect()) or contents(c, *rest))
    found = repeats.digests(docs(spark, rows), window=40).collect()
    assert sorted(map(tuple, found), key=repr) == brute_repeats(rows, 40)
    uids = {r["uid"]: r["doc_id"] for r in repeats.keyed(docs(spark, rows)).collect()}
    assert {uids[c["uid"]] for c in asked[0]} <= {3, 4} and any(c["n"] == 1 for c in asked[0])


def test_removed_spans_and_kept_bytes_make_up_the_text(spark):
    rows = passages(random.Random(10), 20)
    for row in repeats.without_repeats(docs(spark, rows), window=20).collect():
        assert row["n_bytes"] == len(row["kept"]) + sum(s["end"] - s["begin"] for s in row["spans"])
    assert repeats.digests(docs(spark, []), window=20).collect() == []


# -- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in beside.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), words[w], len(beside[w]), words.get(form.get(w))) for w in words)


@pytest.mark.parametrize(("cell", "leaf"), [(spelling.CELL, spelling.LEAF), (16, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PAIRS", 500)
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdeéÿÀ", k=rng.randint(4, 8))) for _ in range(40)]

    def edited(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return [w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcZ×") + w[i:], w[:i] + rng.choice("abÀ") + w[i + 1 :]][kind]

    rows = [(i, " ".join(edited(rng.choice(base[: rng.choice([5, 40])])) for _ in range(80))) for i in range(60)]
    rows += [(None, "Hello hello HELLO hallo hallo"), (500, None), (501, ""), (502, "1 2 3"), rows[0], rows[0]]
    rows += [(503, " ".join(["y" * 5000] * 4 + ["y" * 4999] * 9))]
    found = spelling.variants(docs(spark, rows)).collect()
    assert sorted(map(tuple, found)) == brute_variants(rows)


def test_chains_of_forms_end_at_their_root(spark):
    words, n = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"], 3
    rows = []
    for k, word in enumerate(words):
        rows += [(k, " ".join([word] * (n * 2**k)))]
    found = spelling.variants(docs(spark, rows)).collect()
    assert {r["root"] for r in found} == {"bbbbb"} and sorted(map(tuple, found)) == brute_variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None), (2, "")])).collect() == []
