"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling.

Words enter as a word vector, the mean vector of their character n-grams (both learned and hashed), and what the sample
says of the word and its n-grams: how much more often, surely, they stand in toxic documents. The network
reads every window of WINDOW words (they overlap by OVERLAP), pools its states by attention and scores the window; a
document's score is that of its highest window. Labels are known for documents only: a window of a toxic document is
a positive example if it holds one of the words or n-grams that the labelled sample ties to toxicity.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, remainder, table, with_columns
from .words import _LOWER, Words, chunks, distinct, mix, words

WINDOW, OVERLAP = 32, 8
#: Rows of the two hashed tables of vectors, and the vectors' width.
BUCKETS, DIM, HIDDEN, POOL = 1 << 15, 8, 8, 8
#: Rows of the hashed tables of what the sample says.
EVIDENCE = 1 << 18
#: Inputs of a word that are not learned: sure evidence and log odds of the word, and greatest and mean of its n-grams'.
FIXED = 4
#: Evidence (log odds) from which on a word makes a toxic document's window a positive example.
TELLING = 1.8
GRAMS = (3, 5, 8)
#: Labelled rows of each class that the model is fitted on at most, and their characters (but for the last text).
PER_CLASS, CHARS = 1500, 4_000_000


class Vocabulary:
    """The distinct words of some texts: a word bucket, and the buckets of its n-grams (as one flat list).

    Buckets are of the tables of evidence; their last bits are those of the tables of vectors.
    """

    def __init__(self, w: Words):
        hashes, at, self.index = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.n = len(hashes)
        self.word = (hashes & np.uint64(EVIDENCE - 1)).astype(np.int64)
        start, end = w.start[at], w.end[at]
        length = end - start
        # The words' bytes with a border sign on each side, one after the other.
        first = np.concatenate([[0], np.cumsum(length + 2)])
        flat = np.full(int(first[-1]), 1, np.uint64)
        place = np.arange(int(first[-1])) - np.repeat(first[:-1], length + 2)
        inner = (place > 0) & (place <= np.repeat(length, length + 2))
        flat[inner] = _LOWER[w.data[(np.repeat(start, length + 2) + place - 1)[inner]]]
        grams, owners = [], []
        with np.errstate(over="ignore"):
            for n in GRAMS:
                last = np.repeat(length + 2 - n, length + 2)
                here = np.flatnonzero(place <= last)
                value = np.full(len(here), n, np.uint64)
                for k in range(n):
                    value = value * np.uint64(0x100000001B3) + flat[here + k]
                grams.append((mix(value) & np.uint64(EVIDENCE - 1)).astype(np.int64))
                owners.append(np.repeat(np.arange(self.n), length + 2)[here])
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.gram, self.owner = gram[order], owner[order]
        self.counts = np.bincount(self.owner, minlength=self.n)

    def only(self, chosen: np.ndarray) -> Vocabulary:
        """The chosen words alone, in their order."""
        out = object.__new__(Vocabulary)
        counts = self.counts[chosen]
        out.owner = np.repeat(np.arange(len(chosen)), counts)
        before = np.cumsum(self.counts) - self.counts
        out.gram = self.gram[before[chosen][out.owner] + np.arange(len(out.owner)) - np.repeat(np.cumsum(counts) - counts, counts)]
        out.n, out.word, out.counts = len(chosen), self.word[chosen], counts
        return out

    def vectors(self, m: dict) -> np.ndarray:
        """Word and character inputs side by side, one row for each distinct word."""
        out = np.zeros((self.n, 2 * DIM + FIXED), np.float32)
        out[:, :DIM] = m["words"][self.word % BUCKETS]
        out[:, 2 * DIM] = m["word_evidence"][self.word]
        out[:, 2 * DIM + 3] = m["word_odds"][self.word]
        if len(self.gram):
            full = np.flatnonzero(self.counts)
            starts = np.concatenate([[0], np.cumsum(self.counts[full])[:-1]])
            sums = np.add.reduceat(m["grams"][self.gram % BUCKETS], starts, axis=0)
            out[full, DIM : 2 * DIM] = sums / self.counts[full, None]
            out[full, 2 * DIM + 1] = np.maximum.reduceat(m["gram_evidence"][self.gram], starts)
            out[full, 2 * DIM + 2] = np.add.reduceat(m["gram_odds"][self.gram], starts) / self.counts[full]
        return out


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every window, and its text. Windows cover each text whole."""
    n = np.diff(w.first)
    step = WINDOW - OVERLAP
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = w.first[:-1][doc] + rank * step
    return begin, np.minimum(WINDOW, w.first[1:][doc] - begin), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _direction(gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, r: np.ndarray, rc: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction. gates: input part of every distinct word; keep: gets each step's values."""
    steps, size = index.shape[1], len(index)
    out = np.empty((steps, size, HIDDEN), gates.dtype)
    h = np.zeros((size, HIDDEN), gates.dtype)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        x = gates[index[:, t]]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ r)
        z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + (reset * h) @ rc)
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if keep is not None:
            keep.append((t, h, z, reset, c))
        h = new
        out[t] = h
    return out


def _pooled(m: dict, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = np.tanh(states @ m["A"])
    e = u @ m["a"]
    if mask is not None:
        e = np.where(mask.T, e, -1e9)
    weight = np.exp(e - e.max(0))
    weight /= weight.sum(0)
    return u, weight, np.einsum("tb,tbh->bh", weight, states)


def _scores(m: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    both = [_direction(vectors @ m[f"X{d}"] + m[f"B{d}"], index, mask, m[f"R{d}"], m[f"C{d}"], d == 1) for d in (0, 1)]
    pooled = _pooled(m, np.concatenate(both, 2), mask)[2]
    return pooled @ m["o"] + m["q"]


def score(m: dict, texts: list[str], chars: int = 500_000) -> np.ndarray:
    """The highest window's probability of each text; a text without words gets the probability m["empty"]."""
    out = np.full(len(texts), float(m["empty"]))
    for a, b in chunks(texts, chars):
        w = words(texts[a:b])
        begin, size, doc = windows(w)
        if not len(begin):
            continue
        vocabulary = Vocabulary(w)
        vectors = vocabulary.vectors(m)
        logit = np.empty(len(begin), np.float32)
        full = np.flatnonzero(size == WINDOW)
        for part in np.array_split(full, max(1, len(full) // 4096)):
            if len(part):
                logit[part] = _scores(m, vectors, vocabulary.index[begin[part, None] + np.arange(WINDOW)], None)
        rest = np.flatnonzero(size < WINDOW)
        for part in np.array_split(rest, max(1, len(rest) // 4096)):
            if len(part):
                place = np.arange(WINDOW)
                mask = place < size[part, None]
                index = vocabulary.index[np.minimum(begin[part, None] + place, len(vocabulary.index) - 1)]
                logit[part] = _scores(m, vectors, index, mask)
        best = np.full(b - a, -np.inf)
        np.maximum.at(best, doc, logit)
        has = np.isfinite(best)
        out[a:b][has] = _sigmoid(np.clip(best[has], -30, 30))
    return out


def _evidence(pos: np.ndarray, neg: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the log odds of its toxic and clean documents less 1.5 standard errors (0 at least), and shrunk."""
    odds = np.log((pos + 0.5) / max(1, int(toxic.sum()))) - np.log((neg + 0.5) / max(1, int((~toxic).sum())))
    sure = odds - 1.5 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return np.maximum(0, sure).astype(np.float32), (odds * (pos + neg) / (pos + neg + 20)).astype(np.float32)


def _all_evidence(texts: list[str], toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The fixed tables: evidence and log odds of the words' buckets and of the n-grams', from the documents they stand in."""
    counts = np.zeros((2, 2, EVIDENCE))  # words or n-grams, clean or toxic
    for a, b in chunks(texts, 200_000):
        w = words(texts[a:b])
        v = Vocabulary(w)
        seen = distinct(w.doc * np.int64(max(1, v.n)) + v.index)
        of, part = seen // max(1, v.n), v.only(seen % max(1, v.n))
        for kind, item, at in ((0, part.word, of), (1, part.gram, of[part.owner])):
            pair = distinct(at * np.int64(EVIDENCE) + item)
            for label in (0, 1):
                counts[kind, label] += np.bincount((pair % EVIDENCE)[toxic[a:b][pair // EVIDENCE] == label], minlength=EVIDENCE)
    out = {}
    for kind, name in enumerate(("word", "gram")):
        out[f"{name}_evidence"], out[f"{name}_odds"] = _evidence(counts[kind, 1], counts[kind, 0], toxic)
    return out


def _examples(v: Vocabulary, m: dict, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to learn from: positive ones, clean ones that hold a sign, and all other clean ones.

    Of a toxic document the windows that hold a sign are positive; if none does, the one of the surest word is.
    """
    strength = m["word_evidence"][v.word].copy()
    np.maximum.at(strength, v.owner, m["gram_evidence"][v.gram])
    of_place = strength[v.index]
    best = np.maximum.reduceat(np.append(of_place, 0), np.stack([begin, begin + size], 1).ravel())[::2] if len(begin) else np.zeros(0)
    top = np.full(len(toxic), -1.0)
    np.maximum.at(top, doc, best)
    hit = best > TELLING
    positive = toxic[doc] & (hit | ((top[doc] <= TELLING) & (best == top[doc])))
    return np.flatnonzero(positive), np.flatnonzero(~toxic[doc] & hit), np.flatnonzero(~toxic[doc] & ~hit)


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = 3, updates: int = 300) -> dict:
    """Weights by back-propagation through time and Adam over windows: so many epochs, and more until so many updates.

    Every third document is kept aside to place the threshold with; after that the tables of evidence are counted anew
    over all documents. Of the clean windows without a sign every epoch draws other ones, twice as many as are positive.
    """
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    m = {"words": normal(BUCKETS, DIM, s=0.02), "grams": normal(BUCKETS, DIM, s=0.02), "A": normal(2 * HIDDEN, POOL), "a": normal(POOL), "o": normal(2 * HIDDEN), "q": np.float32(-1.0), "empty": 0.01}
    m |= {name: np.zeros(EVIDENCE, np.float32) for name in ("word_evidence", "word_odds", "gram_evidence", "gram_odds")}
    for d in (0, 1):
        m |= {f"X{d}": normal(2 * DIM + FIXED, 3 * HIDDEN), f"B{d}": np.zeros(3 * HIDDEN, np.float32), f"R{d}": normal(HIDDEN, 2 * HIDDEN), f"C{d}": normal(HIDDEN, HIDDEN)}
    toxic = np.asarray(labels, int) == 1
    if len(set(toxic[0::3])) < 2 or len(set(np.delete(toxic, np.s_[0::3]))) < 2:
        return m  # too few examples
    learned, of_learned = [t for i, t in enumerate(texts) if i % 3], np.delete(toxic, np.s_[0::3])
    m |= _all_evidence(learned, of_learned)
    w = words(learned)
    begin, size, doc = windows(w)
    v = Vocabulary(w)
    positive, hard, easy = _examples(v, m, begin, size, doc, of_learned)
    target = of_learned[doc].astype(np.float32)
    place = np.arange(WINDOW)
    moments: dict = {}
    step = 0
    drawn = min(len(easy), max(2 * len(positive), 2000))
    batches = max(1, (len(positive) + len(hard) + drawn) // 256)
    for _ in range(max(epochs, -(-updates // batches))):
        used = np.concatenate([positive, hard, rng.choice(easy, drawn, replace=False)])
        for part in np.array_split(rng.permutation(used), batches):
            mask = place < size[part, None]
            index = v.index[np.minimum(begin[part, None] + place, len(v.index) - 1)]
            used_words, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            step += 1
            _update(m, moments, step, *_gradients(m, v, used_words, index, mask, target[part]))
    return _calibrated(m, texts[0::3], toxic[0::3]) | _all_evidence(texts, toxic)


def _calibrated(m: dict, texts: list[str], toxic: np.ndarray, share: float = 0.1) -> dict:
    """Move the score's offset so that 0.5 parts the fitted documents best, with a share of them toxic."""
    p = np.clip(score(m, texts), 1e-9, 1 - 1e-9)
    logit = np.log(p / (1 - p))
    order = np.argsort(logit)
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())[order]
    is_toxic = toxic[order]
    # Wrong if the first k documents are called clean and the others toxic.
    wrong = np.concatenate([[0], np.cumsum(np.where(is_toxic, weight, 0))]) + (weight * ~is_toxic).sum() - np.concatenate([[0], np.cumsum(np.where(is_toxic, 0, weight))])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(np.clip(best[len(best) // 2], 1, len(order) - 1))
    return m | {"q": np.float32(m["q"] - (logit[order[k - 1]] + logit[order[k]]) / 2)}


def _gradients(m: dict, v: Vocabulary, chosen: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the dense weights, and of the vectors: (rows, values) for each hashed table."""
    v = v.only(chosen)
    spread, gram = v.owner, v.gram
    share = (1 / np.maximum(1, v.counts)).astype(np.float32)
    vectors = v.vectors(m)
    kept: list[list] = [[], []]
    both = [_direction(vectors @ m[f"X{d}"] + m[f"B{d}"], index, mask, m[f"R{d}"], m[f"C{d}"], d == 1, kept[d]) for d in (0, 1)]
    states = np.concatenate(both, 2)
    u, weight, pooled = _pooled(m, states, mask)
    dy = ((_sigmoid(np.clip(pooled @ m["o"] + m["q"], -30, 30)) - y) / len(y)).astype(np.float32)
    g = {"o": pooled.T @ dy, "q": dy.sum()}
    dpooled = dy[:, None] * m["o"]
    dstates = weight[:, :, None] * dpooled
    dweight = np.einsum("tbh,bh->tb", states, dpooled)
    de = weight * (dweight - (weight * dweight).sum(0))
    g["a"] = np.einsum("tb,tbp->p", de, u)
    du = de[:, :, None] * m["a"] * (1 - u**2)
    g["A"] = np.einsum("tbh,tbp->hp", states, du)
    dstates += du @ m["A"].T
    dvectors = np.zeros_like(vectors)
    # Every chosen word stands at one place at least; the gradients of its places are added up in one go.
    order = np.argsort(index.T, axis=None, kind="stable")
    starts = np.searchsorted(index.T.ravel()[order], np.arange(len(chosen)))
    for d in (0, 1):
        r, rc = m[f"R{d}"], m[f"C{d}"]
        dplaces = np.empty((*index.T.shape, 3 * HIDDEN), np.float32)
        dr, drc, dh = np.zeros_like(r), np.zeros_like(rc), np.zeros((len(y), HIDDEN), np.float32)
        for t, h, z, reset, c in reversed(kept[d]):
            dh = dh + dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            live = mask[:, t, None]
            dnew = np.where(live, dh, 0)
            dc = dnew * z * (1 - c**2)
            dz = dnew * (c - h) * z * (1 - z)
            drh = dc @ rc.T
            dreset = drh * h * reset * (1 - reset)
            drc += (reset * h).T @ dc
            dzr = np.concatenate([dz, dreset], 1)
            dr += h.T @ dzr
            dplaces[t] = np.concatenate([dzr, dc], 1)
            dh = np.where(live, dnew * (1 - z) + drh * reset + dzr @ r.T, dh)
        dgates = np.add.reduceat(dplaces.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
        g |= {f"R{d}": dr, f"C{d}": drc, f"X{d}": vectors.T @ dgates, f"B{d}": dgates.sum(0)}
        dvectors += dgates @ m[f"X{d}"].T
    return g, {"words": (v.word % BUCKETS, dvectors[:, :DIM]), "grams": (gram % BUCKETS, dvectors[spread, DIM : 2 * DIM] * share[spread, None])}


def _update(m: dict, moments: dict, step: int, dense: dict, sparse: dict, rate: float = 0.01) -> None:
    for k, g in dense.items():
        a, b = moments.get(k, (0.0, 0.0))
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        moments[k] = a, b
        m[k] = (m[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    for k, (rows, g) in sparse.items():
        for d in range(DIM):
            m[k][:, d] -= np.float32(0.05) * np.bincount(rows, g[:, d], BUCKETS).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = CHARS) -> dict:
    """Fit on a bounded sample of labelled documents (see common.labelled), read whole."""
    rows = labelled(docs, labels.where(remainder("doc_id", 5) != 0), "toxic", per_class, chars).toPandas().sort_values(["doc_id", "text"])
    return fit(list(rows.text), list(rows.label))


def scored(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score (0 to 1) to every row; all windows of whole texts are read, slice by slice. Null counts as an empty
    text, equal texts get equal scores, and an empty table stays empty. A column of the score's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # hashed tables of fixed size: 6 MB

    def scorer() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(score(sent.value, texts), pa.float64())]

    return with_columns(docs, text, [T.StructField(name, T.DoubleType())], scorer)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
