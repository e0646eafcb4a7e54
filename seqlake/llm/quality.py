"""Operator 6: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of PASSAGE words). Every passage is encoded from the kinds of bytes it is made
of, gated attention weighs the passages, and the weighted sum is scored. Only documents have labels; the weights of
the passages are learned from them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, remainder, table, with_columns
from .words import NOT_SPACE, chunks, words

#: Words of a passage.
PASSAGE = 64
#: Labelled rows of each class that the model is fitted on at most, and their characters (but for the last text).
PER_CLASS, CHARS = 1000, 4_000_000
HIDDEN, GATE = 16, 8

# Kinds of bytes: lower case, upper case, digit, space, line end, sentence signs, other signs, non-ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[32, 9]], _KIND[[10, 13]], _KIND[[33, 44, 46, 58, 59, 63]] = 3, 4, 5
_SIGN = np.where(np.arange(256) < 128, np.arange(256), 128)
WIDTH = 129 + 64 + 5


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and the number of the first passage of each text (one more at the end)."""
    w = words(texts, NOT_SPACE)
    per_doc = np.diff(w.first)
    rank = np.arange(len(w.start)) - np.repeat(w.first[:-1], per_doc)
    bags = -(-per_doc // PASSAGE)
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    if not n:
        return np.zeros((0, WIDTH), np.float32), first
    of_word = np.repeat(first[:-1], per_doc) + rank // PASSAGE
    opens = np.flatnonzero(rank % PASSAGE == 0)
    # A passage's bytes run from its first word to the end of its last.
    closes = np.append(opens[1:], len(w.start)) - 1
    mark = np.zeros(len(w.data) + 1, np.int64)
    mark[w.start[opens]] += 1
    np.add.at(mark, w.end[closes], -1)
    inside = np.cumsum(mark[:-1]).astype(bool)
    number = np.cumsum(np.bincount(w.start[opens], minlength=len(w.data)))[inside] - 1
    data = w.data[inside]
    signs = np.bincount(number * 129 + _SIGN[data], minlength=n * 129).reshape(n, 129)
    kind = _KIND[data]
    same = number[1:] == number[:-1]
    pairs = np.bincount((number[1:] * 64 + kind[:-1] * 8 + kind[1:])[same], minlength=n * 64).reshape(n, 64)
    length = (w.end - w.start).astype(np.float64)
    hashes = w.hashes()
    again = np.zeros(len(hashes))
    for back in (1, 2):
        again[back:] = np.maximum(again[back:], (hashes[back:] == hashes[:-back]) & (of_word[back:] == of_word[:-back]))
    order = np.lexsort((hashes, of_word))
    new = np.ones(len(order))
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    count = np.bincount(of_word, minlength=n).astype(np.float64)
    mean = np.bincount(of_word, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, n) / count - mean**2, 0))
    extra = np.stack([mean / 8, spread / 8, np.bincount(of_word, again, n) / count, np.bincount(of_word[order], new, n) / count, np.log1p(count)], 1)
    total = np.maximum(signs.sum(1, keepdims=True), 1)
    return np.hstack([np.sqrt(signs / total), np.sqrt(pairs / total), extra]).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> tuple:
    """Hidden vectors, gates, attention weights, bag vectors and scores; a bag without passages has the zero vector."""
    bags = len(first) - 1
    of = np.repeat(np.arange(bags), np.diff(first))
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["w"]
    top = np.full(bags, -np.inf)
    np.maximum.at(top, of, e)
    a = np.exp(e - top[of])
    a /= np.bincount(of, a, bags)[of]
    z = np.zeros((bags, h.shape[1]))
    np.add.at(z, of, a[:, None] * h)
    return of, h, t, s, a, z, _sigmoid(z @ m["c"] + m["d"])


def fit(texts: list[str], labels: list[int], seed: int = 7, epochs: int = 12) -> dict:
    """Weights of the encoder, the gated attention and the score, by Adam on the bags' log loss."""
    rng = np.random.default_rng(seed)
    y_all = np.asarray(labels, float)
    m = {
        "W": rng.normal(0, 0.08, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(()), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH),
    }
    if not texts:
        return m
    parts = [passages(texts[a:b]) for a, b in chunks(texts)]
    x = np.vstack([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    if len(x):
        m["mean"], m["scale"] = x.mean(0), x.std(0) + 0.02
    weight = np.where(y_all == 1, 0.5 / max(y_all.mean(), 1e-9), 0.5 / max(1 - y_all.mean(), 1e-9))
    learned = [k for k in m if k not in ("mean", "scale")]
    first_moment, second_moment, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y_all))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch]) if len(batch) else np.zeros(0, int)
            bounds = np.concatenate([[0], np.cumsum(first[batch + 1] - first[batch])])
            xb = x[rows]
            of, h, t, s, a, z, p = _forward(m, xb, bounds)
            dy = (p - y_all[batch]) * weight[batch] / len(batch)
            g = {"c": z.T @ dy, "d": dy.sum()}
            dz = dy[:, None] * m["c"]
            da = (h * dz[of]).sum(1)
            de = a * (da - np.bincount(of, a * da, len(batch))[of])
            g["w"] = (t * s).T @ de
            dts = de[:, None] * m["w"]
            dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = a[:, None] * dz[of] + dt @ m["V"].T + ds @ m["U"].T
            dpre = dh * (1 - h**2)
            g["W"], g["b"] = ((xb - m["mean"]) / m["scale"]).T @ dpre + 1e-4 * m["W"], dpre.sum(0)
            step += 1
            for k in learned:
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g[k]
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g[k] ** 2
                m[k] = m[k] - 0.005 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score(m: dict, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in chunks(texts, 250_000):
        x, first = passages(texts[a:b])
        out[a:b] = _forward(m, x, first)[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = CHARS) -> dict:
    """Fit on a bounded sample of labelled documents (see common.labelled), read whole."""
    rows = labelled(docs, labels.where(remainder("doc_id", 3) != 1), "quality", per_class, chars).toPandas().sort_values(["doc_id", "text"])
    return fit(list(rows.text), list(rows.label))


def scored(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score (0 to 1) to every row; whole texts are read, slice by slice. Null and empty texts get the score of an
    empty bag, equal texts equal scores, and an empty table stays empty. A column of the score's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes, whatever the input

    def scorer() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(score(sent.value, texts), pa.float64())]

    return with_columns(docs, text, [T.StructField(name, T.DoubleType())], scorer)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
