"""Held-out accuracy of the quality and toxicity classifiers, gradients by finite differences, and edge cases."""

import zlib

import numpy as np
import pytest

from seqlake.llm import quality, toxicity
from seqlake.llm.words import words

SF = "/root/testdata/sf0.1"


# About 3 % of this table's toxic documents, 6 % of the held-out ones, hold none of the words that mark the others.
@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(quality, "quality", 3, 1, (0.97, 0.97)), (toxicity, "toxic", 5, 0, (0.97, 0.85))])
def test_held_out_accuracy(spark, module, label, modulus, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    rows = module.scored(docs.join(labels, "doc_id").select("doc_id", "text", label), model).collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == held]
    right = {v: np.mean([(r.score >= 0.5) == v for r in rows if r[label] == v]) for v in (0, 1)}
    assert right[0] >= least[0] and right[1] >= least[1] and len(rows) > 500


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    model = module.fit(["good text here"] * 10 + ["BAD!! TEXT!! idiot"] * 10, [0] * 10 + [1] * 10)
    rows = [(1, None, "a", 2.0), (2, "", "a", 2.0), (3, " \n ", "a", 2.0), (4, "word " * 50000, "a", 2.0), (4, "x" * 100000, "a", 2.0), (None, "é ü", "a", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    out = module.scored(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out[:3]}) == 1
    assert module.scored(df.limit(0), model).count() == 0
    untrained = module.train(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert module.scored(df, untrained).count() == 6


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_that_disagree_and_texts_read_whole(spark, module):
    """Of an id's labels 1 counts; the sign stands behind 300,000 characters, and equal rows get equal scores."""
    far = "fine words here " * 20000
    rows = [(i, far + ("AAAA!!!! idiot idiot " * 40 if i % 2 else "")) for i in range(1, 13)]
    labels = [(i, i % 2, i % 2) for i, _ in rows] + [(i, 0, 0) for i, _ in rows if i % 2] + [(None, 1, 1), (2, None, None)]
    model = module.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = module.scored(spark.createDataFrame([rows[0], rows[0], rows[1]], "doc_id long, text string"), model).collect()
    assert out[0].score == out[1].score != out[2].score


def test_scores_against_one_text_at_a_time(spark, small):
    """The windows of a text one by one: its score is that of the highest, and no slice or batch changes it."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = sorted(texts)
    model = toxicity.fit([texts[i] + (" idiot" if i % 2 else "") for i in some], [i % 2 for i in some], updates=20)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for i in some:
        w = words([texts[i]])
        v, step = toxicity.Vocabulary(w), toxicity.WINDOW - toxicity.OVERLAP
        n, at, best = len(w.start), 0, -np.inf
        while n:
            index = v.index[at : at + toxicity.WINDOW][None]
            best = max(best, float(toxicity._scores(model, v.vectors(model), index, None)[0]))
            if at + toxicity.WINDOW >= n:
                break
            at += step
        assert abs(got[i] - (1 / (1 + np.exp(-best)) if n else model["empty"])) < 1e-4, i


def test_quality_against_one_bag_at_a_time(spark, small):
    """Gated attention written out for one document after the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    m = quality.fit([texts[i] for i in sorted(texts)], [i % 2 for i in sorted(texts)], epochs=2)
    got = {r.doc_id: r.score for r in quality.scored(docs, m).collect()}
    for i, t in texts.items():
        x, first = quality.passages([t])
        h = [np.tanh((v - m["mean"]) / m["scale"] @ m["W"] + m["b"]) for v in x]
        e = np.array([np.tanh(v @ m["V"]) * (1 / (1 + np.exp(-(v @ m["U"])))) @ m["w"] for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(h) else []
        z = sum((w * v for w, v in zip(a, h, strict=True)), np.zeros(quality.HIDDEN))
        assert abs(got[i] - 1 / (1 + np.exp(-(z @ m["c"] + m["d"])))) < 1e-6


def test_toxicity_gradients():
    texts = ["one two three four five six", "seven eight nine", "two nine idiot ten"]
    m = toxicity.fit(texts, [0, 0, 1])
    w = words(texts)
    v = toxicity.Vocabulary(w)
    begin, size, doc = toxicity.windows(w)
    place = np.arange(toxicity.WINDOW)
    mask = place < size[:, None]
    index = v.index[np.minimum(begin[:, None] + place, len(v.index) - 1)]
    distinct, local = np.unique(index, return_inverse=True)
    y = np.array([0, 0, 1], np.float32)
    m = {k: np.asarray(x, np.float64) for k, x in m.items()}

    def loss():
        p = 1 / (1 + np.exp(-toxicity._scores(m, v.vectors(m).astype(float), index, mask)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    dense, sparse = toxicity._gradients(m, v, distinct, local.reshape(mask.shape), mask, y)
    rng = np.random.default_rng(0)
    for k in ("R0", "C1", "X0", "X1", "A", "a", "o"):
        at = tuple(rng.integers(n) for n in m[k].shape)
        old, h = m[k][at], 1e-3
        m[k][at] = old + h
        up = loss()
        m[k][at] = old - h
        down = loss()
        m[k][at] = old
        assert abs((up - down) / (2 * h) - dense[k][at]) < 2e-4, k


def test_windows_cover_all_words():
    w = words(["a " * n for n in (0, 1, 31, 32, 33, 56, 57, 200)])
    begin, size, doc = toxicity.windows(w)
    seen = {(d, i) for b, s, d in zip(begin, size, doc, strict=True) for i in range(b, b + s)}
    assert len(seen) == len(w.start) and all(w.doc[i] == d for d, i in seen)
