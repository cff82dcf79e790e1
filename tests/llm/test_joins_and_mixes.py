"""Jaccard join, mixing, cover-tree search, the registered queries and the pipeline on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline import session
from touchline.llm import common, components, covertree, jaccard, mixing
from touchline.llm.common import find_package
from touchline.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = SPACED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def near_copies(rng, bases, copies):
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    texts = []
    for _ in range(bases):
        base = rng.choices(words, k=rng.randint(30, 90)) + (passage if rng.random() < 0.5 else [])
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("block", [jaccard.BLOCK_CLASSES, 5])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rng = random.Random(block)
    texts = near_copies(rng, 14, 12) + near_copies(rng, 1, 40)
    texts += [None, "", " \n", "One two", "one TWO", "one two three four five", "a b c d e f", "a b c d e f"]
    rows = jaccard.jaccard_components(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)


def test_a_chain_of_blocks_is_joined_only_by_its_links(spark, monkeypatch):
    # A long chain: each text links with its neighbours only, so representatives alone would not connect it.
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[4 * i : 4 * i + 60]) for i in range(60)]
    rows = jaccard.jaccard_components(docs(spark, texts)).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len({c for _, c in want.values()}) == 1


def shared_phrases(rng):
    """Texts of few words, whose shingles meet by chance, and near copies among them and of them."""
    words = [f"v{i}" for i in range(7)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 24))) for _ in range(170)]
    return texts + [t + rng.choice([" end", " end of it", ""]) for t in texts[:60]] + near_copies(rng, 4, 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_and_narrower_groups_change_no_component(spark, monkeypatch, seed):
    for name, value in {"BLOCK_CLASSES": 6, "PART_KEYS": 500, "PART_ROWS": 300, "GROUPS_SHARE": 0.4}.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = shared_phrases(random.Random(seed))
    rows = jaccard.jaccard_components(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)


def test_a_group_of_shared_phrases_is_not_paired_block_by_block(spark, monkeypatch):
    # By short phrases nearly all of the texts hang together in one group, but few of them link.
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 6)
    seen, plain = [], jaccard.joined
    monkeypatch.setattr(jaccard, "joined", lambda blocks, keys: seen.append(blocks.count()) or plain(blocks, keys))
    texts = shared_phrases(random.Random(3))
    rows = jaccard.jaccard_components(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)
    assert max(seen) <= len(texts) and sum(seen) < 3 * len(texts)


def size_below(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_only_the_classes_stay_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    texts = near_copies(random.Random(5), 30, 12)
    table = docs(spark, texts).cache()
    table.count()
    before = shuffle_files(spark)
    rows = jaccard.classes(table)
    made = shuffle_files(spark) - before
    assert [p.name.split("-")[-1] for p in tmp_path.glob("*/*")] == ["classes"]
    # What is left are counts that reach the driver: the hashes alone have more bytes than texts.
    assert size_below(tmp_path) < 40 * len(texts) + 8000 and len(made) < 100
    assert rows.count() == len(texts) and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_copies_in_several_tasks_share_no_keys(spark, tmp_path):
    texts = [" ".join(f"q{i}x{j}" for j in range(40)) for i in range(20)] * 8
    table = docs(spark, texts).repartition(8, "doc_id")
    tables = common.Tables(spark, "copies")
    sets = tables.put("sets", jaccard.sets_of(table))
    assert sets.where("size(p0) > 0").count() > 20
    assert jaccard.candidate_keys(sets, tables).isEmpty()
    assert {r["component_id"] for r in jaccard.jaccard_components(table).collect()} == set(range(20))


def test_first_documents_are_shuffled_once(spark):
    conf, name = spark.conf, "spark.sql.autoBroadcastJoinThreshold"
    table = docs(spark, near_copies(random.Random(6), 6, 4))
    before = conf.get(name)
    conf.set(name, "-1")
    try:
        text = jaccard.one_of_each(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)
    # One for the texts, two for the classes: their components, and the ids of these.
    assert text.count("Exchange hashpartitioning") == 3


def test_tree_prunes_only_pairs_that_cannot_link():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 200)).astype(np.uint64)) for _ in range(30)]
    sets = [b[rng.random(len(b)) < p] for b in base for p in (1.0, 0.9, 0.8)]
    sets = [s for s in sets if len(s)]
    tree = jaccard.SignatureTree(sets)
    for level, nodes in enumerate(tree.levels):
        span = jaccard.FANOUT**level
        size = len(nodes[0])
        may = jaccard.may_link(nodes, slice(0, size), slice(0, size))
        for i in range(len(sets)):
            for j in range(len(sets)):
                if jaccard.linked(tree.hashes[i], tree.hashes[j]):
                    assert may[i // span, j // span]
    assert not jaccard.may_link(tree.levels[0], slice(0, 90), slice(0, 90)).all()


def test_repeated_and_null_ids(spark):
    text = "this is one text of seven words"
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (None, "quite another text with seven words"), (9, None), (9, "")]
    table = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, th string, cls long")
    got = sorted(map(str, jaccard.jaccard_components(table).select("doc_id", "component_id").collect()))
    assert got == sorted(f"Row(doc_id={i}, component_id={c})" for i, c in [(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (9, 9), (9, 9)])
    kept = jaccard.one_of_each(table)
    assert kept.schema == table.schema
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(["Row(doc_id=3)", "Row(doc_id=None)", "Row(doc_id=9)", "Row(doc_id=9)"])
    twice = table.where("doc_id = 5")
    assert jaccard.one_of_each(twice).count() == 1
    assert jaccard.jaccard_components(table.limit(0)).isEmpty() and jaccard.one_of_each(table.limit(0)).isEmpty()


def test_components_of_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(4, None)]
    label = {n: n for e in edges for n in e if n is not None and e[0] != e[1] and None not in e}
    for _ in range(70):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label


# -- mixing


def test_a_large_neighbourhood_is_dealt_to_many_tasks(spark):
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 4000)] + [(9000, 3), (9001, 9000)], "u long, v long")
    least, told = components._least(pairs)
    assert {tuple(r) for r in told.collect()} == {(r["u"], r["v"], r["v"]) for r in pairs.collect()}
    both = pairs.unionByName(pairs.select(pairs.v.alias("u"), pairs.u.alias("v")))
    salts = both.where("u = 0").select((F.pmod(F.xxhash64("v"), F.lit(components.SALTS))).alias("s")).groupBy("s").count()
    assert salts.count() > components.SALTS / 2 and salts.agg(F.max("count")).first()[0] < 60
    assert {r["u"]: r["m"] for r in components._least(both)[0].where("u in (0, 3, 9000)").collect()} == {0: 1, 3: 0, 9000: 3}
    assert {r["component"] for r in components.components(pairs.toDF("a", "b")).collect()} == {0}


def test_mix_follows_targets(spark):
    rng = random.Random(9)
    sources = ["hot"] * 6 + ["b", "c", None, "tiny"]
    texts = [" ".join(["w"] * rng.randint(0, 80)) for _ in range(900)] + ["w " * 20_000, None, ""]
    table = docs(spark, texts, sources)
    table = table.unionByName(table.limit(5))
    rows = mixing.mixture(table).collect()
    assert len(rows) == len(texts) + 5
    by = defaultdict(lambda: [0, 0, 0.0])
    source_of = {i: sources[i % len(sources)] for i in range(len(texts))}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        entry = by[source_of[r["doc_id"]]]
        entry[0] += r["size"]
        entry[1] += r["taken"]
        entry[2] = r["target"]
        assert r["source_size"] > 0
    total = sum(e[0] for e in by.values())
    assert abs(sum(e[2] for e in by.values()) - total) < 1e-6 * total
    for size, taken, target in by.values():
        assert target <= 3 * size + 1e-6 and taken == math.floor(target + 0.5)
    order = ["b", "c", "hot", "tiny", None]
    free = [s for s in order if by[s][2] < 3 * by[s][0] - 1e-6]
    shares = {by[s][2] / (order.index(s) % 3 + 1) for s in free}
    assert max(shares) - min(shares) < 1e-6 * total
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(table.repartition(7)).collect()))


def test_small_sources_meet_their_targets(spark):
    # Sources of 5, 33, 40 and 12 words beside a large one; some targets are smaller than a slot.
    sizes = {"a": [2, 3], "b": [33], "c": [10, 30], "d": [1] * 12, None: [90] * 60}
    flat = [(s, n) for s, many in sizes.items() for n in many]
    table = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(flat)], DOCS)
    taken = defaultdict(int)
    for r in mixing.documents_taken(table).collect():
        assert 0 < r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert taken == {"a": 15, "b": 99, "c": 120, "d": 36, None: 5490 - 270}


def test_sources_smaller_than_a_slot_take_their_targets_in_query_and_stage(spark):
    sizes = {"a": [5], "b": [20], "c": [20, 20], None: [50] * 200}
    flat = [(s, n) for s, many in sizes.items() for n in many]
    table = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(flat)], DOCS)
    taken, source_of = defaultdict(int), dict(enumerate(s for s, _ in flat))
    rows = mixing.mixture(table).collect()
    for r in rows:
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert taken == {"a": 15, "b": 60, "c": 120, None: 10_065 - 195}
    staged = {r["doc_id"]: r["taken"] for r in mixing.documents_taken(table).collect()}
    assert staged == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


# Columns that the operators add, and some that they use inside.
CLASHES = ("n_entities", "size", "Taken", "digest", "worn", "copy", "key", "hits", "windows", "score", "label", "cls", "place", "block", "of", "k0")


@pytest.mark.parametrize("with_chars", [True, False])
def test_stages_keep_columns_of_any_name(spark, with_chars):
    find_package(spark)
    texts = ["write to ann.lee@corp.org now please " + "word " * 9, None, "", "plain words stay here " * 3]
    rows = [(i, t, "en", "s", *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    table = spark.createDataFrame(rows, schema)
    if with_chars:
        table = table.withColumn("n_chars", mixing.F.length("text").cast("long"))
    others = ["doc_id", *CLASHES]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, table, SF)
        assert done.columns[: len(table.columns)] == table.columns, name
        kept = {r["doc_id"] for r in done.select("doc_id").collect()}
        want = sorted(map(str, table.where(table.doc_id.isin(list(kept))).select(*others).collect()))
        assert sorted(map(str, done.select(*others).collect())) == want, name
    assert done.columns[len(table.columns) :] == ["size_", "taken_"]


def test_points_are_spread_evenly(spark):
    points = sorted(r[0] for r in spark.range(4096).select(mixing.point(mixing.F.col("id"))).collect())
    gaps = np.diff(points)
    assert gaps.max() < 3 / 4096 and points[0] >= 0 and points[-1] < 1
    far = spark.range(1 << 37, (1 << 37) + 4096).select(mixing.point(mixing.F.col("id"))).collect()
    assert np.diff(sorted(r[0] for r in far)).max() < 3 / 4096


def test_mix_of_odd_tables(spark):
    table = docs(spark, [None, "", " "])
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mixture(table).collect()] == [(0, 0, 0.0)] * 3
    assert mixing.mixture(table.limit(0)).isEmpty() and mixing.documents_taken(table.limit(0)).isEmpty()
    one = docs(spark, ["a b c"] * 4, ["s"]).withColumnsRenamed({"lang": "key", "n_chars": "copy"})
    taken = mixing.documents_taken(one)
    assert taken.columns == [*one.columns, "size", "taken"] and taken.agg({"taken": "sum"}).first()[0] == 12


# -- search


def brute_top_k(rows, k=10):
    import math

    usable = [
        (u, i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for u, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for u, i, q in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for w, j, v in usable if w != u and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [covertree.BLOCK, 60])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 3 if block < 100 else covertree.QUERY_BLOCK)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]
    rows += [(100, rows[100][1]), (100, rows[3][1]), (None, rows[1][1]), (700, None), (800, [1.0, None] * 4), (900, [float("nan")] * 8), (1100, [float("inf")] * 8)]
    rows += [(1200, [1.0, 2.0]), (1201, [0.5, 0.5]), (1300, []), (1301, []), (-100, [1e6] * 8), (-200, [-1e6] * 8), (2000, [1.0])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, uid int, dim int")
    found = covertree.top_k(table)
    assert sorted(map(tuple, found.collect())) == brute_top_k(rows)
    assert covertree.top_k(table.limit(0)).isEmpty()


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, [1e6, 7.0]), (1, [2e6, 1.0]), (2, [2e6, 1.0009765625]), (3, [-2e6, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, covertree.top_k(table).collect()))
    exact = lambda v: [int(np.floor(1024 * x)) for x in v]
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    scores = {i: clip(sum(a * b for a, b in zip(exact(rows[0][1]), exact(v), strict=True))) for i, v in rows[1:]}
    assert got == [(0, 1, 2, scores[2]), (0, 2, 1, scores[1]), (0, 3, 3, scores[3])]


def test_tied_large_scores_go_to_the_smaller_id(spark):
    # Scores that doubles cannot tell apart, more of them than k, over several blocks and cells.
    rows = [(100 * i, [2e6 + i, 1.0]) for i in range(3)] + [(1 + 100 * i, [2e6, 7.0 if i % 2 else 7.0009765625]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, covertree.top_k(table).collect()))
    exact = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    for query in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(exact[query], v, strict=True)), i) for i, v in exact.items() if i != query)[:10]
        assert [(r, i, s) for q, r, i, s in got if q == query] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


@pytest.mark.parametrize(("width", "least"), [(0.05, 0.8), (0.5, 0.6)])
def test_clustered_vectors_are_mostly_ruled_out(spark, width, least):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 64))
    vectors = centres[rng.integers(30, size=8000)] + width * rng.normal(size=(8000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    scored = covertree.candidates(table).agg({"scored": "sum"}).first()[0]
    assert 1 - scored / (80 * 8000) > least


def test_cells_hold_all_rows_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(covertree, "SAMPLE", 12)
    monkeypatch.setattr(covertree, "CELL_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = [(i, (10 * rng.normal(size=3)).tolist()) for i in range(300)]
    rows += [(5000 + i, [0.5] * (i % 40)) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.top_k(table).collect())) == brute_top_k(rows)


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare.compare(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name]) is None


def test_pipeline_stages(spark):
    find_package(spark)
    rng = random.Random(8)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = near_copies(rng, 8, 5) + [f"{item} and something {i}" for i in range(3)] + [f"mail me at user{i}@corp.org soon please friend {i}" for i in range(5)] + [None, ""]
    table = docs(spark, texts)
    want = brute_components(texts)
    step = corpus_pipeline.near_duplicates(spark, table, SF)
    assert step.columns == table.columns
    assert {r["doc_id"] for r in step.collect()} == {c for _, c in want.values()}
    step = corpus_pipeline.personal_data(spark, table, SF)
    assert step.columns == table.columns and step.where("text like '%corp.org%'").isEmpty() and step.count() == len(texts)
    step = corpus_pipeline.source_mix(spark, table, SF)
    assert step.where("taken < 1 or taken > 3 * size").isEmpty() and set(table.columns) < set(step.columns)


def test_pipeline_runs_on_the_tables(spark):
    find_package(spark)
    rows = corpus_pipeline.run(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < rows.count() <= documents.count()
    assert rows.join(documents, "doc_id", "left_anti").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    for table in (documents.limit(0),):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
        assert table.isEmpty()
