"""Operator 10: approximate nearest neighbours by adaptive dimension scan within inverted lists.

Vectors are scaled to length 1 and turned by one random rotation, so that their first dimensions are a fair sample of
all. Every vector is put into the list of its nearest centroid. A query visits its nearest lists and scans each
list's vectors in blocks of columns: after each block a hypothesis test on the partial distance gives up the
candidates that can hardly be among the query's nearest. Those that last are scored on the original vectors.

Lists are packed into cells of about the same size, and long lists are cut, so that a query is sent to a cell once,
whatever number of its lists it visits. Rows that repeat are filed once, with their number; of equal vectors only the
k + 1 smallest ids can be among any query's k nearest (ties go to the smaller id), so no more of them are filed. All
lengths and all sizes go the same way; each length has its own rotation, centroids and cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled, table, written

#: Vectors that the centroids are fitted on (about; twice as many at most), and the most lists. All vectors are put into lists.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Lists for each square root of the number of vectors; share of them that a query visits, and how many at least.
DENSITY, PROBED, LEAST_PROBED = 2.0, 0.55, 8
#: Columns of a block, and the test's width: larger gives up fewer candidates.
BLOCK, WIDTH = 16, 2.1
#: Vectors (of 64 components; of more fewer) and queries of one group of work, about.
GROUP = 16_384
#: Stands for a null id, so that pandas makes no floats of the others.
NO_ID = (1 << 63) - 1


def is_single(df: DataFrame, embedding: str) -> bool:
    return isinstance(df.schema[embedding].dataType.elementType, T.FloatType)


def usable(vectors: DataFrame, vec_id: str, embedding: str, single: bool) -> DataFrame:
    """(id, dims, v, rows) of the vectors that take part: not null or empty, all components finite, not all zero. v: the components'
    bytes, as 32-bit floats if single, else as 64-bit ones. rows: how many rows hold that id and vector."""
    kind = np.float32 if single else np.float64
    v = F.col(embedding) if single else F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "dims": [len(x) for x in pdf.v], "v": [(np.asarray(x, kind) + kind(0)).tobytes() for x in pdf.v]})

    return rows.mapInPandas(coded, "id long, dims int, v binary").groupBy("id", "dims", "v").agg(F.count("*").alias("rows"))


def matrix(v: Iterable[bytes], single: bool) -> np.ndarray:
    v = list(v)
    return np.frombuffer(b"".join(v), np.float32 if single else np.float64).reshape(len(v), -1).astype(np.float64)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the greatest component is divided out first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an empty list gets a random vector of the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=len(sample) < lists)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), sample[rng.integers(len(sample), size=lists)])
    return c


def scanned(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int, width: float = WIDTH, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of places that last through all blocks of columns. own: of each query the place of the vector that
    is no candidate of it; -1 if there is none.

    Both sides are rotated and of length 1. A query's bound is the distance of its k-th nearest among a first few
    vectors, scanned whole, or what earlier lists have left in limits, if that is less. With d of D columns read, a
    candidate is given up if its partial squared distance times D / d is more than (1 + width / sqrt(d))**2 times the
    bound. Every test allows for rounding: among exact copies the distances and the bound are noise around 0.
    """
    n, dims = vectors.shape
    first = min(n, max(4 * k, 64))
    exact = 2 - 2 * (queries @ vectors[:first].T)
    exact[own[:, None] == np.arange(first)[None]] = np.inf
    bound = np.partition(exact, k - 1, axis=1)[:, k - 1].clip(0) if first > k else np.full(len(queries), np.inf)
    if limits is not None:
        bound = np.minimum(bound, limits)
    q_at, v_at = np.nonzero((exact <= bound[:, None] + 1e-9) & np.isfinite(exact))
    out = [(q_at, v_at)]
    if first == n:
        return out[0]
    rest = vectors[first:]
    read = min(BLOCK, dims)
    a, b = queries[:, :read].astype(np.float32), rest[:, :read].astype(np.float32)
    partial = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
    keep = partial * (dims / read) <= ((1 + width / np.sqrt(read)) ** 2 if read < dims else 1) * bound[:, None] + 1e-5
    q_at, v_at = np.nonzero(keep)
    far = ((queries[q_at, :read] - rest[v_at, :read]) ** 2).sum(1) if read == dims else partial[q_at, v_at].astype(np.float64)
    while read < dims and len(q_at):
        upto = min(dims, read + BLOCK)
        for part in np.array_split(np.arange(len(q_at)), max(1, len(q_at) // 200_000)):
            far[part] += ((queries[q_at[part], read:upto] - rest[v_at[part], read:upto]) ** 2).sum(1)
        read = upto
        limit = bound[q_at] * ((1 + width / np.sqrt(read)) ** 2 if read < dims else 1) + 1e-6
        stay = far * (dims / read) <= limit
        q_at, v_at, far = q_at[stay], v_at[stay], far[stay]
    other = own[q_at] != v_at + first
    return np.concatenate([out[0][0], q_at[other]]), np.concatenate([out[0][1], v_at[other] + first])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, with the greatest component of each row divided out first."""
    a = a / np.abs(a).max(1, keepdims=True)
    b = b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Best:
    """The k best candidates of each query so far: score descending, then id."""

    def __init__(self, queries: int, k: int):
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), NO_ID)

    def limits(self, rows: np.ndarray) -> np.ndarray:
        """Squared distance between vectors of length 1 beyond which nothing gets in."""
        return 2 - 2 * self.score[rows, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.score.shape[1]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        top = rank < k
        rows = row[new]
        more_score, more_id = np.full((len(rows), k), -np.inf), np.full((len(rows), k), NO_ID)
        at = np.searchsorted(rows, row[top])
        more_score[at, rank[top]], more_id[at, rank[top]] = score[top], ids[top]
        both, both_id = np.hstack([self.score[rows], more_score]), np.hstack([self.id[rows], more_id])
        order = np.lexsort((both_id, -both), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)


def _searched(q: np.ndarray, q_lists: list[np.ndarray], own: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_list: np.ndarray, v_rows: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best among the vectors of those lists that it visits. Vectors are original ones; own: the
    place of the vector of which one row is the query's own, or -1; v_rows: rows that hold a vector."""
    found = Best(len(q), k)
    turned_q, turned_v = _unit(q) @ turn, _unit(v) @ turn
    alone = np.where((own >= 0) & (v_rows[own] == 1), own, -1)
    visitor, visited = np.repeat(np.arange(len(q)), [len(x) for x in q_lists]), np.concatenate(q_lists) if len(q_lists) else np.zeros(0, int)
    for number in np.unique(visited):
        rows, at = np.flatnonzero(v_list == number), visitor[visited == number]
        if not len(rows):
            continue
        place = np.full(len(v) + 1, -1)  # in the list, and of no vector
        place[rows] = np.arange(len(rows))
        for part in np.array_split(at, max(1, len(at) * len(rows) // 4_000_000)):
            a, b = scanned(turned_q[part], place[alone[part]], turned_v[rows], k, limits=found.limits(part))
            a, b = part[a], rows[b]
            for some in np.array_split(np.arange(len(a)), max(1, len(a) // 100_000)):
                x, y = a[some], b[some]
                times = np.minimum(v_rows[y] - (own[x] == y), k)
                found.add(np.repeat(x, times), np.repeat(v_ids[y], times), np.repeat(cosine(q[x], v[y]), times))
    row, at = np.nonzero(np.isfinite(found.score))
    return row, found.id[row, at], found.score[row, at]


def best(queries: DataFrame, vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by cosine, largest first, ties to the smaller id (null last).

    queries and vectors have the columns vec_id and embedding; others do not count. A query's candidates are all rows of vectors
    but its own: where a row of vectors holds the query's id and vector, one such row is left out. Rows that repeat are
    candidates each, and ask each. Vectors that are null, zero, or hold null or non-finite components take no part. A vector's
    candidates are those of its own length: every length is searched by itself. With fewer than k candidates all are
    returned; empty tables give no rows.
    """
    single = is_single(vectors, embedding) and is_single(queries, embedding)
    few = Window.partitionBy("v", "dims").orderBy("id")
    base = written(usable(vectors, vec_id, embedding, single).withColumn("__n", F.dense_rank().over(few)).where(F.col("__n") <= k + 1).drop("__n"))
    asked = written(usable(queries, vec_id, embedding, single).withColumn("nr", F.monotonically_increasing_id()))
    pairs = _in_lists(base, asked, single, k, probed)
    # Each group of work sends k rows for a query at most; the window keeps k before it shuffles, and k after.
    order = Window.partitionBy("nr").orderBy(F.col("score").desc(), "vec_id", "copy")
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asks = top.withColumn("__ask", F.explode(F.sequence(F.lit(1).cast("long"), "asks")))
    return asks.select(F.nullif("query_id", F.lit(NO_ID)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


PAIRS = "nr long, query_id long, asks long, vec_id long, copy int, score double"


class Lists:
    """The lists of one length: rotation, centroids, which cell a list lies in, and the parts of the cells."""

    def __init__(self, dims: int, n: int, sample: np.ndarray, probed: float):
        self.group = int(np.clip(GROUP * 64 // dims, min(GROUP, 512), GROUP))
        self.lists = int(np.clip(round(DENSITY * n**0.5), 1, MOST_LISTS))
        self.turn = rotation(dims)
        self.centre = centroids((_unit(sample) @ self.turn).astype(np.float32), self.lists)
        self.visits = min(self.lists, max(LEAST_PROBED, int(np.ceil(probed * self.lists))))

    def near(self, v: np.ndarray) -> np.ndarray:
        return (_unit(v) @ self.turn).astype(np.float32) @ self.centre.T

    def pack(self, size: np.ndarray) -> None:
        """Lists in their order fill a cell; a list that is larger is one by itself. Cells of more than a group are cut into parts."""
        self.cell, filled = np.zeros(self.lists, np.int64), 0
        for i in range(1, self.lists):
            filled += size[i - 1]
            self.cell[i] = self.cell[i - 1] + (filled + size[i] > self.group)
            filled = filled if self.cell[i] == self.cell[i - 1] else 0
        self.parts = np.maximum(1, -(-np.bincount(self.cell, size) // self.group)).astype(np.int64)


def _lengths(pdf: pd.DataFrame, made: dict[int, Lists], step: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of each length for which there are lists, step at a time."""
    for dims, some in pdf.groupby("dims"):
        if dims in made:
            for a in range(0, len(some), step):
                yield int(dims), some.iloc[a : a + step]


def _in_lists(base: DataFrame, asked: DataFrame, single: bool, k: int, probed: float) -> DataFrame:
    """By lists, cells of lists, and parts of cells of each length."""
    spark = base.sparkSession
    made: dict[int, Lists] = {}
    for r in base.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():  # a row for each length
        # The sample is bounded, and so are the centroids.
        sample = sampled(base.where(F.col("dims") == r.dims).select("v"), "v", SAMPLE, r.n).limit(2 * SAMPLE).toPandas()
        made[r.dims] = Lists(r.dims, r.n, matrix(sample.v, single), probed)
    sent = spark.sparkContext.broadcast(made)

    def to_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, some in _lengths(pdf, sent.value, 2048):
                yield some.assign(list=np.argmax(sent.value[dims].near(matrix(some.v, single)), 1).astype(np.int32))

    filed = written(base.mapInPandas(to_lists, "id long, dims int, v binary, rows long, list int"))
    size = {dims: np.zeros(x.lists, np.int64) for dims, x in made.items()}
    for r in filed.groupBy("dims", "list").count().collect():  # a row for each list
        size[r.dims][r.list] = r["count"]
    for dims, x in made.items():
        x.pack(size[dims])
    q_parts = {r.dims: max(1, round(r.n / made[r.dims].group)) for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect() if r.dims in made}
    rows = [(d, i, int(x.cell[i]), int(x.parts[x.cell[i]]), q_parts[d]) for d, x in made.items() if d in q_parts for i in range(x.lists)]
    cells = F.broadcast(spark.createDataFrame(rows, "dims int, list int, cell int, parts int, q_parts int"))  # a row for each list
    sent_cells = spark.sparkContext.broadcast(made)

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, some in _lengths(pdf, sent_cells.value, 512):
                x = sent_cells.value[dims]
                visited = np.sort(np.argpartition(-x.near(matrix(some.v, single)), x.visits - 1, 1)[:, : x.visits], 1)  # and so are their cells
                at, cell = np.repeat(np.arange(len(some)), x.visits), x.cell[visited.ravel()]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(at) != 0)]))
                yield some.iloc[at[first]].assign(cell=cell[first], lists=np.split(visited.ravel(), first[1:]), parts=x.parts[cell[first]], q_part=some.nr.to_numpy()[at[first]] % q_parts[dims])

    filed = filed.join(cells, ["dims", "list"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    filed = filed.select("dims", "id", "v", "rows", "list", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"))
    visiting = asked.mapInPandas(to_visits, "id long, dims int, v binary, rows long, nr long, cell int, lists array<int>, parts int, q_part int")
    visiting = visiting.select("dims", "id", "v", "rows", "nr", "lists", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q_part")

    def scan(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({x.split()[0]: np.zeros(0, np.int64) for x in PAIRS.split(", ")})
        place = {x: i for i, x in enumerate(zip(v.id, v.v, strict=True))}
        own = np.array([place.get(x, -1) for x in zip(q.id, q.v, strict=True)])
        row, ids, score = _searched(matrix(q.v, single), [np.asarray(x) for x in q.lists], own, matrix(v.v, single), v.id.to_numpy(), v.list.to_numpy(), v.rows.to_numpy(), sent.value[int(q.dims.iloc[0])].turn, k)
        some = q.iloc[row]
        return pd.DataFrame({"nr": some.nr, "query_id": some.id, "asks": some.rows, "vec_id": ids, "copy": np.arange(len(row)) % k, "score": score})

    keys = ["dims", "cell", "part", "q_part"]
    return visiting.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInPandas(scan, PAIRS)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return best(vectors.where("vec_id % 50 = 0"), vectors)
