"""Operator 1: n-gram Jaccard join by chosen paths.

A text is the set of its runs of SHINGLE words. Equal texts form one class, and classes are joined whose sets have a
Jaccard similarity of THRESHOLD or more. The join is randomised and recursive: a run splits all classes on a sampled
token that they share (the minimum of a random hash over the set, so that two sets share it with a probability equal to
their similarity); buckets of more than LEAF classes are split again on two further tokens, up to LEVELS times; the
buckets that remain are compared by brute force. Runs are repeated until the recall reaches its target: at similarity
0.8 a pair is missed in one run with a probability of 0.2 to 0.26, in all six with 0.0003, and rarer above.

In a bucket, sketches of SKETCH hashes sort out the pairs that are far below the threshold (five standard deviations),
and the pairs that a smaller bucket's number owns already; what is left is compared by the exact sets. A bucket only
reports how many links each class has there and one link of each class to its component (a tree in which no class has many),
so no list of pairs is made.

Within a part of a bucket near copies are not compared pair by pair either: Jaccard distance is a metric, so the exact
distances to one class tell of most pairs that they are links, or none; only the others' sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import chunks, mix, words

SHINGLE, THRESHOLD = 5, 0.8
#: Hashes of a sketch; below this many equal ones (of SKETCH) a pair is not looked at: 0.8 less five standard deviations.
SKETCH, LEAST = 64, 35
#: Runs are repeated until pairs at the threshold are found with this probability; a run misses one with MISSED at most.
RECALL, MISSED = 0.9996, 0.26
RUNS, LEVELS = math.ceil(math.log(1 - RECALL) / math.log(MISSED)), 3
#: Classes of a bucket that is not split any more, and of a part of a bucket that one task compares with another.
LEAF, PART = 4096, 512
#: Buckets of so many classes at most are compared many at a time, about BIN rows together.
SMALL, BIN = 48, 2000
#: Parts that the rows of a frequent key are dealt to, and rows that such a key has at least.
SALTS, MANY = 32, 1000
#: Pivots whose distances are looked at before sets are compared, and pairs below which none is.
PIVOTS, FEW = 4, 2000
#: Classes that are linked to one of their component in a bucket's report.
FAN = 8
#: Nodes of a run's tree, level by level: 1, 2, 4, ...
NODES = (1 << LEVELS) - 1

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = _rng.permutation(SKETCH)[:RUNS]


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words (lower-cased A-Z; a text of fewer words is one run), and where each text's begin."""
    w = words(texts)
    h = w.hashes()
    count = np.diff(w.first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(w.first[:-1], runs) + np.arange(first[-1]) - np.repeat(first[:-1], runs)
    size = np.repeat(np.minimum(count, n), runs)
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = size > k
            out = np.where(inside, mix(out * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(at + k, max(0, len(h) - 1))]), out) if len(h) else out
    return out, first


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH minima of random 32-bit hashes for each set; sets without a member get zeros."""
    out = np.zeros((len(first) - 1, SKETCH), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        starts = first[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(SKETCH):
                out[full, k] = np.minimum.reduceat(((h * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def paths(sketch: np.ndarray) -> np.ndarray:
    """Node numbers of every set (rows) in every run's tree, level by level: a node's children are chosen by its number."""
    out = np.zeros((len(sketch), RUNS * NODES), np.uint64)
    rows = np.arange(len(sketch))
    with np.errstate(over="ignore"):
        for run in range(RUNS):
            at = run * NODES
            out[:, at] = mix(sketch[:, _FIRST[run]].astype(np.uint64) * np.uint64(SKETCH) + np.uint64(run + 1))
            for node in range(1, NODES):
                above = out[:, at + (node - 1) // 2]
                pick = (mix(above + np.uint64(node)) % np.uint64(SKETCH)).astype(np.int64)
                out[:, at + node] = mix(above ^ mix(sketch[rows, pick].astype(np.uint64) * np.uint64(SKETCH) + np.uint64(node)))
    return out


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf.text)
        for a, b in chunks(texts):
            h, first = shingles(texts[a:b])
            s = sketches(h, first)
            p = paths(s).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id[a:b], "key": pdf.key[a:b], "size": np.diff(first), "sketch": [x.tobytes() for x in s], "paths": list(p)})


def _with_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf.text)
        for a, b in chunks(texts):
            h, first = shingles(texts[a:b])
            yield pd.DataFrame({"key": pdf.key[a:b], "members": [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(b - a)]})


def _earlier(leaves: list, i: np.ndarray, j: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket of a smaller number than the one they are met in: they are reported there."""
    longest = max(map(len, leaves))
    table_ = np.full((len(leaves), longest), np.iinfo(np.int64).max)
    for row, x in enumerate(leaves):
        table_[row, : len(x)] = x
    out = np.zeros(len(i), bool)
    for part in np.array_split(np.arange(len(i)), max(1, len(i) * longest * longest // 4_000_000)):
        a, b = table_[i[part]], table_[j[part]]
        out[part] = ((a[:, :, None] == b[:, None, :]) & (a < leaf[part, None])[:, :, None]).any((1, 2))
    return out


def _pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket whose sketches are near, without those that an earlier bucket reports.

    The rows are two parts of a large bucket (or one that meets itself), or many small buckets whole.
    """
    sketch = np.frombuffer(b"".join(pdf.sketch), np.uint32).reshape(-1, SKETCH)
    leaf = pdf.leaf.to_numpy()
    if pdf.large.iloc[0]:
        part = pdf.part.to_numpy()
        a, b = np.flatnonzero(part == pdf.x.iloc[0]), np.flatnonzero(part == pdf.y.iloc[0])
        equal = np.zeros((len(a), len(b)), np.uint8)
        for k in range(SKETCH):
            equal += sketch[a, k, None] == sketch[None, b, k]
        near = equal >= LEAST
        if pdf.x.iloc[0] == pdf.y.iloc[0]:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
    else:
        order = np.argsort(leaf, kind="stable")
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for step in range(1, SMALL):
            a, b = order[:-step], order[step:]
            same = leaf[a] == leaf[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            near = (sketch[a] == sketch[b]).sum(1) >= LEAST
            found.append((a[near], b[near]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(i):
        new = ~_earlier(list(pdf.leaves), i, j, leaf[i])
        i, j = i[new], j[new]
    return i, j


def _similar_few(sets: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As _similar, pair by pair."""
    values = {r: np.frombuffer(sets[r], np.uint64) for r in np.unique(np.concatenate([i, j]))}
    inter = np.array([len(np.intersect1d(values[a], values[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], float)
    sizes = np.array([len(values[a]) + len(values[b]) for a, b in zip(i, j, strict=True)])
    return inter >= THRESHOLD * (sizes - inter) - 1e-9


def _similar(mine: list[bytes], other: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly. Sets are sorted arrays of 64-bit hashes."""
    sets = [np.frombuffer(x, np.uint64) for x in mine], [np.frombuffer(x, np.uint64) for x in other]
    sizes = [np.array([len(x) for x in side]) for side in sets]
    rows, cols = np.unique(i), np.unique(j)
    tokens, index = np.unique(np.concatenate([*(sets[0][r] for r in rows), *(sets[1][c] for c in cols)]), return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(rows)), sizes[0][rows]), len(rows) + np.repeat(np.arange(len(cols)), sizes[1][cols])])
    left, right = owner < len(rows), owner >= len(rows)
    seen = np.bincount(index[left], minlength=len(tokens)) > 0
    both = seen & (np.bincount(index[right], minlength=len(tokens)) > 0)
    common = np.zeros((len(rows), len(cols)), np.float32)
    number = np.cumsum(both) - 1
    keep = both[index]
    index, owner, left = number[index[keep]], owner[keep], left[keep]
    order = np.argsort(index, kind="stable")
    index, owner, left = index[order], owner[order], left[order]
    total = int(both.sum())
    width = max(256, 8_000_000 // (len(rows) + len(cols)))
    for a in range(0, total, width):
        lo, hi = np.searchsorted(index, (a, a + width))
        x, y = np.zeros((len(rows), min(width, total - a)), np.float32), np.zeros((len(cols), min(width, total - a)), np.float32)
        l_ = left[lo:hi]
        x[owner[lo:hi][l_], index[lo:hi][l_] - a] = 1
        y[owner[lo:hi][~l_] - len(rows), index[lo:hi][~l_] - a] = 1
        common += x @ y.T
    inter = common[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.float64)
    return inter >= THRESHOLD * (sizes[0][i] + sizes[1][j] - inter) - 1e-9


def _told(sets: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold, exactly: from the distances to a few pivots where the triangle inequality decides, by
    the sets where it doesn't. A pivot is the place in most of the pairs that are left."""
    out, left = np.zeros(len(i), bool), np.arange(len(i))
    for _ in range(PIVOTS):
        if len(left) < FEW:
            break
        pivot = int(np.argmax(np.bincount(np.concatenate([i[left], j[left]]))))
        far = _distances(sets, pivot, np.unique(np.concatenate([i[left], j[left]])))
        a, b = far[i[left]], far[j[left]]
        near, apart = a + b <= 1 - THRESHOLD + 1e-12, np.abs(a - b) > 1 - THRESHOLD + 1e-9
        # Pairs of the pivot itself are told by the distance.
        out[left[near]] = True
        rest = ~(near | apart)
        if rest.sum() > 0.9 * len(left):
            break
        left = left[rest]
    for part in np.array_split(left, max(1, len(left) // 200_000)):
        if len(part):
            out[part] = _similar(sets, sets, i[part], j[part])
    return out


def _distances(sets: list[bytes], pivot: int, places: np.ndarray) -> np.ndarray:
    """Jaccard distance of the places' sets to the pivot's; nan elsewhere."""
    base = np.frombuffer(sets[pivot], np.uint64)
    values = [np.frombuffer(sets[p], np.uint64) for p in places]
    sizes = np.array([len(x) for x in values])
    all_ = np.concatenate(values)
    at = np.minimum(np.searchsorted(base, all_), len(base) - 1)
    inter = np.bincount(np.repeat(np.arange(len(places)), sizes)[base[at] == all_], minlength=len(places))
    out = np.full(len(sets), np.nan)
    out[places] = 1 - inter / (sizes + len(base) - inter)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _parents(keys: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each place another of its component, so that all are connected and none has more than FAN links to it.

    The members of a component stand in a heap by their order; the first one is its own parent.
    """
    order = np.lexsort((keys, root))
    first = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, len(order))))
    rank = np.arange(len(order)) - begin
    out = np.empty(len(order), np.int64)
    out[order] = order[begin + np.maximum(rank - 1, 0) // FAN]
    return out


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[np.unique(np.concatenate(_pairs(pdf)))]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    i, j = _pairs(pdf)
    if len(i):
        sets = list(pdf.members)
        good = _told(sets, i, j) if pdf.large.iloc[0] else _similar_few(sets, i, j)
        i, j = i[good], j[good]
    count = np.bincount(i, minlength=len(pdf)) + np.bincount(j, minlength=len(pdf))
    has = np.flatnonzero(count)
    keys, root = pdf.key.to_numpy()[has], _roots(len(pdf), i, j)[has]
    return pd.DataFrame({"key": keys, "root": keys[_parents(keys, root)], "links": count[has]})


def leaves(classes: DataFrame) -> DataFrame:
    """(leaf, key) of every class in every bucket of two classes or more that is not split any more."""
    first = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.struct((r * NODES).alias("at"), F.element_at("paths", r * NODES + 1).alias("leaf")))
    now = classes.where("size > 0").select("key", F.inline(first))
    done = None
    for level in range(LEVELS):
        # Counting first: most buckets hold one class and go at once.
        sizes = now.groupBy("leaf").count().where("count > 1")
        now = written(met(written(now), sizes, "leaf", "key").where("count IS NOT NULL"))
        stays = now if level == LEVELS - 1 else now.where(F.col("count") <= LEAF)
        stays = stays.select("leaf", "key", "count")
        done = stays if done is None else done.unionByName(stays)
        if level == LEVELS - 1:
            break
        large = now.where(F.col("count") > LEAF)
        if large.isEmpty():
            break
        child = lambda side: F.col("at") - F.col("at") % NODES + 2 * (F.col("at") % NODES) + side
        below = F.array(*[F.struct(child(s).alias("at"), F.element_at("paths", (child(s) + 1).cast("int")).alias("leaf")) for s in (1, 2)])
        now = large.drop("leaf", "count").join(classes.select("key", "paths"), "key").select("key", F.inline(below))
    return done.distinct()


def met(rows: DataFrame, looked_up: DataFrame, key: str, spread_by: str) -> DataFrame:
    """rows, a written table, left joined with looked_up (one row of each key), so that no frequent key is one task's work.

    Keys of more than a thousandth of the rows (a thousand of them at most, so they are broadcast) are dealt by a salt too, and
    their row of looked_up is copied to every salt.
    """
    total = rows.count()
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > max(MANY, total // 1000)).select(F.col(key).alias("__hot")))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).cast("int")
    salts = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    copied = looked_up.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return dealt.join(copied, [key, "__salt"], "left").drop("__salt")


def components(edges: DataFrame, a: str = "key", b: str = "root") -> DataFrame:
    """(key, group): the smallest key of each key's connected component. edges may repeat and hold loops.

    Labels spread along the edges and are then looked up in themselves, so the rounds grow with the logarithm of a
    component's length. A large component's label is a frequent one: see met. Each round's labels are written to the shared
    folder; only counts reach the driver.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.least("u", "m").alias("group")))
    while True:
        near = edges.join(labels.select(F.col("key").alias("u"), "group"), "u").groupBy(F.col("v").alias("key")).agg(F.min("group").alias("near"))
        spread = written(labels.join(near, "key", "left").select("key", F.least("group", "near").alias("group"), F.col("group").alias("old")))
        # Only keys that are someone's label are looked up.
        jump = spread.select(F.col("key").alias("group"), F.col("group").alias("next")).join(spread.select("group").distinct(), "group")
        new = written(met(spread, jump, "group", "key").select("key", F.coalesce("next", "group").alias("group"), "old"))
        if new.where("group != old").isEmpty():
            return new.select("key", "group")
        labels = new.select("key", "group")


def class_key(text: str) -> Column:
    """64 bits of the text's MD5, by which its class is known. Null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16), 16, -10).cast("long")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_copies, n_links, group_id.

    class_id: the smallest doc_id of the rows with an equal text. n_copies: rows of the class. n_links: other classes
    that the class is linked to. group_id: the smallest class_id of all classes that links connect. Null texts count as
    empty; texts without words form classes by their text and have no links. Null ids take part as any other id and sort
    last. Rows that repeat are copies of one class; texts are read whole; an empty table gives no rows; other columns of docs
    do not count, whatever their names. Where ids are null or repeated, different groups may have one group_id; grouped() tells them apart.
    """
    return grouped(docs, doc_id, text).drop("class_key", "group_key")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As joined, with class_key and group_key: they are made of the texts, so no two classes or groups share one."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("key", class_key("text"))
    # Ids pass through Python as text: pandas would turn whole numbers beside nulls into floats.
    rows_sketched = written(rows.mapInPandas(_sketched, "doc_id string, key long, size long, sketch binary, paths array<long>").withColumn("doc_id", F.col("doc_id").cast("long")))
    classes = rows_sketched.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    # One row of each class stands for it; its columns are those of any row of the class.
    alone = written(rows_sketched.select("key", "size", "sketch", "paths").dropDuplicates(["key"]))
    placed = written(leaves(alone))
    own = placed.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    member = placed.join(alone.select("key", "sketch").join(own, "key"), "key")
    # A large bucket is cut into parts that meet each other; small ones are put together in bins.
    member = member.withColumn("large", F.col("count") > SMALL)
    parts = F.when(F.col("large"), F.ceil(F.col("count") / PART)).otherwise(1).cast("int")
    member = member.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    bins = max(1, placed.where(F.col("count") <= SMALL).count() // BIN)
    member = member.withColumn("bin", F.when(F.col("large"), F.col("leaf")).otherwise(F.pmod("leaf", F.lit(bins))))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("part", p).alias("x"), F.greatest("part", p).alias("y")))
    member = member.select("large", "bin", "leaf", "part", "key", "sketch", "leaves", F.inline(meets))
    group = "large boolean, bin long, leaf long, part int, key long, sketch binary, leaves array<long>, x int, y int"
    near = written(member.groupBy("large", "bin", "x", "y").applyInPandas(_candidates, group))
    # Sets are made again for those classes only that have a near one.
    wanted = near.select("key").distinct()
    # Of a class that many rows hold, those of its smallest id alone are sent on, and all are dealt by their ids, not by the class.
    texts = met(rows, classes.select("key", "class_id").join(wanted, "key"), "key", "doc_id").where(F.col("doc_id").cast("long").eqNullSafe(F.col("class_id"))).select("key", "text")
    sets = texts.mapInPandas(_with_shingles, "key long, members binary").dropDuplicates(["key"])
    found = written(near.join(sets, "key").groupBy("large", "bin", "x", "y").applyInPandas(_links, "key long, root long, links long"))
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    groups = components(found.select("key", "root"))
    linked = written(classes.join(groups, "key"))
    smallest = linked.groupBy("group").agg(F.min("class_id").alias("group_id"))
    linked = met(linked, smallest, "group", "key").select("key", "group", "group_id")
    numbered = classes.join(links, "key", "left").join(linked, "key", "left")
    numbered = written(numbered.select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("group").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group", "key").alias("group_key")))
    out = met(rows_sketched.select("doc_id", "key"), numbered, "key", "doc_id")
    return out.withColumnRenamed("key", "class_key").select("doc_id", "class_id", "n_copies", "n_links", "group_id", "class_key", "group_key")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: the one of the smallest id, nulls last (of rows that share it, the one of the smallest class key)."""
    groups = grouped(docs, doc_id, text)
    first = groups.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_key")).alias("__keep")).select("__keep")
    keyed = docs.withColumn("__key", class_key(text))
    kept = keyed.join(first, keyed[doc_id].eqNullSafe(first["__keep.doc_id"]) & (keyed["__key"] == first["__keep.class_key"]))
    # One class of each group is left: its rows here are equal in id and text.
    return kept.dropDuplicates(["__key"]).drop("__key", "__keep")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).drop("class_key")
