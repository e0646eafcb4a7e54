"""Vector codes against plain loops, the approximation's bounds, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.llm import codes


def by_hand(rows, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    """{id: (code, error, label_error, sha)} of rows (id, vector, label) of one length."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, parts in groups.items():
                books[p][e] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(cut(v, p), books[p]) for p in range(4)] for _, v, _ in kept]
    total = {}
    for (_, _, label), f in zip(kept, found, strict=True):
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[label], sha) for (i, _, label), f in zip(kept, found, strict=True)}


SCHEMA = "vec_id long, embedding array<float>, label int"


def result(df, **parameters):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.product_codes(df, **parameters).collect()}


def test_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=12)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(90)]
    rows += [(200, None, 1), (201, [float("nan")] * 12, 1), (202, [float("inf")] * 12, 1), (203, [None] + [0.0] * 11, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for entries in (7, 256):
        assert result(df, entries=entries) == by_hand(rows, entries=entries)


def test_ties_repeats_lengths_and_large_numbers(spark):
    rows = [(i, [0.25 * (i % 3)] * 8, 0) for i in range(20)]
    assert result(spark.createDataFrame(rows, SCHEMA), entries=6) == by_hand(rows, entries=6)
    odd = [(1, [1.0] * 6, 1), (1, [1.0] * 6, 1), (None, [2.0] * 6, 2), (5, [], 3), (6, [0.5], 3), (7, [3e38, -3e38, 1.0, 0.0], None)]
    got = codes.product_codes(spark.createDataFrame([(*r, "x") for r in odd], f"{SCHEMA}, code string")).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in got if r.vec_id is not None) == [(False, 1, "00000000", 0)] * 2 + [(False, 5, "00000000", 0), (False, 6, "00000000", 0), (False, 7, "00000000", 0)]
    assert [r.code for r in got if r.vec_id is None] == ["02020202"]  # entries 0 and 1 are those of the repeated rows
    assert codes.product_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="entries"):
        codes.product_codes(spark.createDataFrame([], SCHEMA), entries=300)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 9), st.integers(1, 300), st.sampled_from([1, 3, 1000, 1 << 27]), st.integers(1, 4), st.randoms(use_true_random=False))
def test_the_filter_finds_the_nearest(n, width, queries, spread, bits, rng):
    draw = np.random.default_rng(rng.randrange(1 << 30))
    entries, x = draw.integers(-spread, spread, (n, width)), draw.integers(-spread, spread, (queries, width))
    made = codes.Approximation(entries, bits)
    exact = np.square(x[:, None] - entries[None]).sum(2)
    lower, upper = made.bounds(x)
    assert (lower * (1 - codes.SLACK) <= exact).all() and (exact <= upper * (1 + codes.SLACK) + 1e-9).all()
    near, distance, refined = made.nearest(x)
    assert (near == exact.argmin(1)).all() and (distance == exact.min(1)).all() and queries <= refined <= exact.size
