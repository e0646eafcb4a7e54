"""Operator 12: product codes of vectors, by codebooks that are searched through a vector-approximation file.

A vector's components become whole numbers and are cut into parts; each part is coded by the nearest of its codebook's
entries, and the codebooks are moved to their parts' means a few times over. All arithmetic is of whole numbers, so any
split into tasks gives the same codes.

The nearest entry is found through an approximation of the entries: each coordinate is quantised to a few bits, that is
to one of some cells. For each query a look-up table tells, by coordinate and cell, the least and the greatest squared
difference there can be; their sums over an entry's cells bound its distance from below and above. Only entries whose
lower bound does not lie above the query's least upper bound are refined with distances of whole numbers.

What goes through the driver is the codebooks: ENTRIES entries a part, whatever the number of vectors. Each round is one
pass, in which every task sums the parts of each entry before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import matched, table, written

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell, and vectors that are looked up at a time.
BITS, BATCH = 3, 1024
#: Bounds are sums of doubles: so much is allowed for their rounding.
SLACK = 1e-9
Codebooks = dict[int, list[np.ndarray]]


def bounds_of(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end; parts differ by one component at most."""
    return [i * dims // parts for i in range(parts + 1)]


def most(dims: int, parts: int = PARTS) -> int:
    """Components are held within these bounds, so that squared distances of a part are below 2**63."""
    width = max(1, -(-dims // parts))
    return 1 << ((62 - (width - 1).bit_length()) // 2 - 1)


def usable(vectors: DataFrame, embedding: str = "embedding") -> Column:
    """True for vectors that are not null and hold finite components only."""
    v = F.col(embedding)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


class Approximation:
    """The cells of a codebook part's coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries, 1 << bits
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        cell = np.empty((n, width), np.int64)
        np.put_along_axis(cell, order, np.broadcast_to((np.arange(n) * cells // max(n, 1))[:, None], (n, width)), 0)
        # A cell is the range of the values in it; an empty one is never looked up.
        self.low, self.high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
        self.of = np.zeros((width, cells, n))
        for d in range(width):
            for c in range(cells):
                inside = cell[:, d] == c
                if inside.any():
                    self.low[d, c], self.high[d, c] = entries[inside, d].min(), entries[inside, d].max()
            self.of[d, cell[:, d], np.arange(n)] = 1
        self.of = self.of.reshape(width * cells, n)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of each row of x from each entry."""
        below, above = (self.low[None] - x[:, :, None]).astype(float), (x[:, :, None] - self.high[None]).astype(float)
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        flat = lambda t: np.square(t).reshape(len(x), len(self.of)) @ self.of
        return flat(near), flat(far)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row of x the nearest entry (ties to the lower index), its squared distance, and how many distances of whole
        numbers that took."""
        out, distance, refined = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        for a in range(0, len(x), BATCH):
            some = x[a : a + BATCH]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero(lower * (1 - SLACK) <= upper.min(1, keepdims=True) * (1 + SLACK))
            refined += len(row)
            exact = np.concatenate([np.square(some[row[i : i + 65536]] - self.entries[entry[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)])
            first = np.searchsorted(row, np.arange(len(some)))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            hit = hit[np.searchsorted(row[hit], np.arange(len(some)))]  # the first, that is the lowest entry
            out[a : a + BATCH], distance[a : a + BATCH] = entry[hit], exact[hit]
        return out, distance, refined


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, dims and v: the components floor(scale * x) of each usable vector, as the bytes of 32-bit numbers."""
    rows = vectors.where(usable(vectors, embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            limit = np.repeat(np.array([most(int(n)) for n in size], np.float64), size)
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(values * scale), -limit, limit - 1).astype(np.int32)
            data, at = values.tobytes(), np.concatenate([[0], np.cumsum(size * 4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["vec_id", "label", "dims", "v"])

    return rows.mapInArrow(made, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, dims int, v binary")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dims, places in the batch, and the vectors of each length; columns dims and v."""
    dims = batch.column("dims").to_numpy()
    for n in np.unique(dims):
        at = np.flatnonzero(dims == n)
        raw = batch.column("v").take(pa.array(at)).to_pylist()
        yield int(n), at, np.frombuffer(b"".join(raw), np.int32).reshape(len(at), int(n)).astype(np.int64)


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """For each length the parts of the vectors of the smallest ids (nulls last, then by bytes): ENTRIES rows at most."""
    order = Window.partitionBy("dims").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    rows = vectors.select("dims", "vec_id", "v").withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries).orderBy("dims", "n").collect()
    out: Codebooks = {}
    for dims in sorted({r.dims for r in rows}):
        mine = [np.frombuffer(r.v, np.int32) for r in rows if r.dims == dims]
        v = np.array(mine, np.int64).reshape(len(mine), dims)
        at = bounds_of(dims, parts)
        out[dims] = [v[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    return out


def moved(vectors: DataFrame, books: Codebooks, parts: int = PARTS) -> Codebooks:
    """Each entry replaced by the mean of the parts that are nearest to it, componentwise and rounded down; unused ones stay."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(books)
    widest = max((b.shape[1] for book in books.values() for b in book), default=0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {d: [Approximation(b) for b in book] for d, book in sent.value.items()}
        count = {d: [np.zeros(len(b), np.int64) for b in book] for d, book in sent.value.items()}
        total = {d: [np.zeros(b.shape, np.int64) for b in book] for d, book in sent.value.items()}
        for batch in batches:
            for dims, _, v in _by_length(batch):
                at = bounds_of(dims, parts)
                for p, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    near = made[dims][p].nearest(v[:, a:b])[0]
                    count[dims][p] += np.bincount(near, minlength=len(count[dims][p]))
                    np.add.at(total[dims][p], near, v[:, a:b])
        rows = [(d, p, int(e), int(n[e]), [int(x) for x in total[d][p][e]]) for d in count for p, n in enumerate(count[d]) for e in np.flatnonzero(n)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=["dims", "part", "entry", "n", "sums"])

    rows = vectors.select("dims", "v").mapInArrow(sums, "dims int, part int, entry int, n long, sums array<long>")
    summed = rows.groupBy("dims", "part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)])
    out = {d: [b.copy() for b in book] for d, book in books.items()}
    for r in summed.collect():  # a row for each entry
        width = out[r.dims][r.part].shape[1]
        out[r.dims][r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of a codebook's numbers by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of each vector, and how many entries were refined for it."""
    sent = vectors.sparkSession.sparkContext.broadcast((books, {d: digest(b) for d, b in books.items()}))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {d: [Approximation(b) for b in book] for d, book in sent.value[0].items()}
        for batch in batches:
            n = batch.num_rows
            near, error, sha, refined = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.full(n, "", object), np.zeros(n, np.int64)
            for dims, rows, v in _by_length(batch):
                at = bounds_of(dims, parts)
                sha[rows] = sent.value[1][dims]
                for p, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    entry, distance, tried = made[dims][p].nearest(v[:, a:b])
                    near[rows, p] = entry
                    error[rows] += distance
                    refined[rows] += tried // len(rows)
            code = near.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([code[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)]), pa.array(error), pa.array(sha, pa.string()), pa.array(refined)], names=["vec_id", "label", "code", "error", "codebooks_sha256", "refined"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(codes, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string, refined long")


def product_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 and refined of every usable vector.

    Vectors that are null or hold a null or non-finite component are dropped. Rows that repeat are vectors each; null ids come
    last in the order of ids and stay null; rows that share an id are ordered by their components. A codebook of fewer vectors
    than entries has as many entries as vectors. Vectors of another length have codebooks of their own; a length that parts
    does not divide is cut as evenly as can be, and an empty vector has code 0 and error 0. Components beyond what squared
    distances in 64 bits allow (2**28 for parts of 16, that is 262,144 before scaling) count as that bound. Null labels are
    one label. Columns of other names do not count; an empty table gives no rows. entries is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    held = written(whole(vectors, vec_id, embedding, label, scale))
    books = first_entries(held, parts, entries)
    for _ in range(rounds):
        books = moved(held, books, parts)
    rows = written(coded(held, books, parts))
    by_label = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")))
    return matched(rows, by_label, "label", "__n", "vec_id").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256", "refined")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
