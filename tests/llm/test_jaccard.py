"""The join against all pairs by brute force, and its edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from seqlake.llm import jaccard

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def brute(rows):
    """doc_id -> (class_id, n_copies, n_links, group_id), by comparing all texts that share a shingle."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    sets = {}
    for t in texts:
        w = [x.lower() for x in WORD.findall(t.encode())]
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by = defaultdict(list)
    for t, s in sets.items():
        for x in s:
            by[x].append(t)
    pairs = {(a, b) for ts in by.values() for k, a in enumerate(ts) for b in ts[k + 1 :]}
    links = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for t in texts:
        least[find(t)] = min(least[find(t)], *texts[t])
    return {i: (min(texts[t]), len(texts[t]), degree[t], least[find(t)]) for t in texts for i in texts[t]}


def result(df):
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in jaccard.joined(df).collect()}


def test_documents_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


def test_a_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(90)])) for i in range(120)]
    rows += [(2000 + i, " ".join(base)) for i in range(40)]
    found = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute(rows)
    assert {i: (x[0], x[1], x[3]) for i, x in found.items()} == {i: (x[0], x[1], x[3]) for i, x in want.items()}
    missed = sum(x[2] for x in want.values()) - sum(x[2] for x in found.values())
    assert all(found[i][2] <= want[i][2] for i in want)
    assert missed <= 0.002 * sum(x[2] for x in want.values())


def test_large_buckets_are_split_and_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 60)
    monkeypatch.setattr(jaccard, "PART", 20)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(80)], []
    for group in range(12):
        base = passage + [word() for _ in range(60)]
        for i in range(20):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((group * 100 + i, " ".join(w)))
    found, want = result(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows)
    assert {i: x[3] for i, x in found.items()} == {i: x[3] for i, x in want.items()}
    assert all(found[i][2] <= want[i][2] for i in want)
    assert sum(x[2] for x in found.values()) >= 0.995 * sum(x[2] for x in want.values())


def test_edges(spark):
    schema = "doc_id long, text string, class_id string, key string"
    text = "one two three four five six seven eight nine ten"
    rows = [(5, None), (6, ""), (7, "a b"), (8, "A b"), (9, text), (9, text), (10, text.upper()), (11, "!!! ???"), (None, text)]
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()), key=str)
    assert got == sorted([(5, 5, 2, 0, 5), (6, 5, 2, 0, 5), (7, 7, 1, 1, 7), (8, 8, 1, 1, 7), (9, 9, 3, 1, 9), (9, 9, 3, 1, 9), (10, 10, 1, 1, 9), (11, 11, 1, 0, 11), (None, 9, 3, 1, 9)], key=str)
    assert jaccard.joined(spark.createDataFrame([], schema)).count() == 0
    kept = jaccard.deduplicated(spark.createDataFrame([(*r, "x", "y") for r in rows], schema))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 9, 11] and kept.columns == ["doc_id", "text", "class_id", "key"]


def test_different_texts_under_null_and_repeated_ids_all_stay(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(12))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c").upper()), (None, text("c")), (3, text("d")), (3, text("e")), (3, text("e")), (4, text("e").upper()), (None, text("d")), (5, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.deduplicated(df).collect()]
    assert sorted((str(i), t.lower()) for i, t in kept) == [("3", text("d")), ("3", text("e")), ("5", text("f")), ("None", text("a")), ("None", text("b")), ("None", text("c"))]
    assert (3, text("e")) in kept
    got = jaccard.grouped(df).collect()
    assert len(got) == len(rows) and len({r.group_key for r in got}) == 6 and len({r.class_key for r in got}) == 8


def test_the_triangle_inequality_tells_what_the_sets_tell(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = []
    for i in range(160):
        keep = base[rng.random(400) > rng.choice([0.01, 0.05, 0.15])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, 40)), dtype=np.uint64)])).tobytes())
    i, j = np.triu_indices(160, 1)
    monkeypatch.setattr(jaccard, "FEW", 100)
    assert (jaccard._told(sets, i, j) == jaccard._similar_few(sets, i, j)).all()


def test_no_class_has_many_links_in_a_report():
    keys = np.arange(1000)
    root = np.repeat([0, 500], 500)
    parent = jaccard._parents(keys, root)
    assert np.bincount(parent[parent != keys]).max() <= jaccard.FAN
    assert {int(x) for x in parent[:500]} <= set(range(500)) and (np.flatnonzero(parent == keys) == [0, 500]).all()


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, long.replace("w7 ", "v7 ")), (4, "short text of some six words")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [got[i][2:] for i in (1, 2, 3, 4)] == [(2, 1), (2, 1), (2, 1), (0, 4)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("key"), (F.col("id") + 1).alias("root"))
    assert {r.group for r in jaccard.components(edges).collect()} == {0}
