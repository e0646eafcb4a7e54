"""Recall against brute force, exact scores, and edge cases of the nearest-neighbour search."""

import numpy as np
from pyspark.sql import functions as F

from seqlake.llm import neighbours


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[np.flatnonzero(ids == q)[0]]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))
        out[q] = [ids[j] for j in order[:k]]
    return out


def test_recall_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    out = neighbours.op10_neighbours(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert len(out) == 5 * len(want)
    assert np.mean([r.vec_id in want[r.query_id] for r in out]) >= 0.9
    v = {i: np.array(x, float) for i, x in rows}
    for r in out:
        a, b = v[r.query_id], v[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    for q in want:
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(x.score >= y.score for x, y in zip(mine, mine[1:]))


def test_recall_with_many_lists_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(2500, 24)), rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(1500, 24))]).astype(np.float32)
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(v)]
    monkeypatch.setattr(neighbours, "GROUP", 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.best(df.where("vec_id % 50 = 0"), df).collect()
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert len(out) == 5 * len(want)
    assert np.mean([r.vec_id in want[r.query_id] for r in out]) >= 0.9


def test_no_exact_copy_is_given_up():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(1300, 64))
        v[rng.permutation(1300)[:300]] = v[0]
        v = neighbours._unit(v) @ neighbours.rotation(64)
        copies = np.flatnonzero(np.abs(v - v[0]).max(1) < 1e-12)
        q_at, v_at = neighbours.scanned(v[copies], copies, v, 5)
        lasting = np.isin(v_at, copies)
        assert lasting.sum() == len(copies) * (len(copies) - 1)


def test_copies_come_by_the_smallest_ids(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1400, 64)).astype(np.float32)
    copies = np.sort(rng.permutation(1400)[:400])
    v[copies] = v[copies[0]]
    rows = [(int(i), [float(c) for c in v[i]]) for i in rng.permutation(1400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.best(df.where(F.col("vec_id").isin([int(i) for i in copies])), df).collect()
    got = {(r.query_id, r["rank"]): r.vec_id for r in out}
    for q in copies:
        assert [got[q, k] for k in range(1, 6)] == [i for i in copies[:6] if i != q][:5]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (100, [1e300, 1e300]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    out = sorted(map(tuple, neighbours.best(df.where("vec_id % 50 = 0"), df).collect()), key=lambda r: r[:2])
    assert [r[:3] for r in out if r[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, None), (0, 5, 50)]
    assert [r[:3] for r in out if r[0] == 100] == [(100, 1, 1), (100, 2, 2), (100, 3, None), (100, 4, 0), (100, 5, 50)]
    assert all(abs(r[3] - 2**-0.5) < 1e-12 for r in out if r[0] == 0 and r[2] in (1, 2))
    assert neighbours.best(df.where(F.lit(False)), df).count() == 0
    assert neighbours.best(df, df.where(F.lit(False))).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(2, [1.0, 0.5])] * 2 + [(2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    # Each row of id 1 asks, and the two others are its candidates, as are all rows of id 2.
    got = [tuple(r)[:3] for r in neighbours.best(twice.where("vec_id = 1"), twice).collect()]
    assert sorted(got) == sorted([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 2)] * 3)
    other = neighbours.best(spark.createDataFrame([(1, [0.5, 0.0])], "vec_id long, embedding array<double>"), twice, k=4).collect()
    assert [tuple(r)[:3] for r in other] == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 2)]  # it is no row of the table


def test_the_same_way_at_every_size(spark, monkeypatch):
    """Lists, rotation and early abandonment at 500 and 2,000 vectors; the recall is of them."""
    seen = []
    pack = neighbours.Lists.pack
    monkeypatch.setattr(neighbours.Lists, "pack", lambda self, size: seen.append((size.sum(), self)) or pack(self, size))
    for sf in ("sf0.01", "sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        out = neighbours.op10_neighbours(spark, f"/root/testdata/{sf}").collect()
        want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
        n, lists = seen[-1]
        assert n == len(rows) and lists.lists == round(2 * n**0.5) and lists.visits < lists.lists
        assert np.mean([r.vec_id in want[r.query_id] for r in out]) >= 0.9 and len(out) == 5 * len(want)


def test_every_length_is_searched_by_itself(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 2 else 6)]) for i in range(400)] + [(1000, [1.0] * 5), (1050, [1.0] * 7), (1051, [2.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for group in (neighbours.GROUP, 200):
        monkeypatch.setattr(neighbours, "GROUP", group)
        out = neighbours.best(df.where("vec_id % 25 = 0"), df, probed=1.0).collect()
        for dims in (4, 6):
            some = [r for r in rows if len(r[1]) == dims]
            want = brute(some, [i for i, _ in some if i % 25 == 0], 5)
            got = {q: [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] for q in want}
            assert got == want
        assert [tuple(r)[:3] for r in out if r.query_id > 400] == [(1050, 1, 1051)]


def test_a_vector_that_a_third_of_all_rows_hold(spark, monkeypatch):
    """Many more copies than a group of work holds: the smallest ids are found, and few copies are filed."""
    monkeypatch.setattr(neighbours, "GROUP", 400)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    out = neighbours.best(df.where("vec_id % 50 = 0"), df).collect()
    for q in range(0, 3000, 150):
        got = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])]
        assert got == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]
