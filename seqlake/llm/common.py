"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

#: Bytes of texts that a Python task works on at a time (one text at least), whatever the size of Spark's batches.
SLICE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and any executor can read it."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in an order over the whole table, without one task for all rows: rows are dealt by
    ranges of the order, numbered in each range, and moved on by the sizes of the ranges before. order names columns (F.col) and must have no ties."""
    ranges = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    size = ranges.groupBy("__range").agg(F.count("*").alias("__size"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as partitions
    begin = F.broadcast(size.select("__range", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__begin")))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(name, inside.cast("long")).join(begin, "__range").withColumn(name, F.col(name) + F.col("__begin")).drop("__range", "__begin")


#: A key that holds more than one in so many rows is hot: there are fewer of them than this.
HOT = 1000


def matched(rows: DataFrame, groups: DataFrame, key: str, n: str, spread: str) -> DataFrame:
    """rows with the other columns of groups, which has one row for each key (nulls are a key) and in n how many rows have it.

    Hot keys (fewer than HOT of them, by their shares) are broadcast, and their rows dealt by spread instead of the key, so that
    no task gets all rows of a key. Rows without a group have nulls.
    """
    values = [c for c in groups.columns if c not in (key, n)]
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT > total
    side = lambda df, a: df.select(F.col(key).alias(f"{a}_key"), F.struct(*values).alias(a))
    hot, rest = side(groups.where(is_hot), "__hot"), side(groups.where(~is_hot), "__rest").withColumn("__of", F.lit(0))
    out = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot_key")), "left")
    cold = F.col("__hot").isNull()
    out = out.withColumns({"__salt": F.when(cold, 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")), "__own": F.when(cold, F.col(key))})
    out = out.join(rest, (F.col("__salt") == F.col("__of")) & F.col("__own").eqNullSafe(F.col("__rest_key")), "left")
    got = F.coalesce("__hot", "__rest")
    return out.select(*[F.col(_quoted(c)) for c in rows.columns], *[got[v].alias(v) for v in values])


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About so many of df's total rows (all, if there are fewer), by hash of a column: no sort, the same rows each time."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(42), key), F.lit(1_000_000_000)) < int(1_000_000_000 * rows / total))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample: labelled documents in the order of a hash of the id, at most per_class of
    each class, and no more of a class once the texts before have chars characters together. Texts are whole.

    Labels other than 0 and 1 and labels of null ids do not count; where labels of an id disagree, 1 counts. Of documents
    that share a labelled id the one of the smallest text is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    parts = [known.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(label).alias("label"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    return rows.withColumn("__upto", F.sum(F.length("text").cast("long")).over(before)).where(F.col("__upto") - F.length("text") < chars).drop("__upto")


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of a text column, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + SLICE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """df with further columns computed in Python from a text column, slice by slice, so that a task's memory does not grow.

    make is called once in each task and gives the function from texts (null: empty) to the fields' arrays. Columns of df
    that have a field's name are replaced.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    at = next((i for i, f in enumerate(kept) if f.name == text), len(kept))
    # Columns pass through Python by number: a name with a dot would be taken for a field's.
    names = [f"c{i}" for i in range(len(kept))]
    source = df.select(*[F.col(_quoted(f.name)).alias(c) for f, c in zip(kept, names, strict=True)], *([F.col(_quoted(text)).alias("__text")] if at == len(kept) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in sliced(batch, at):
                arrays = work([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], names=[*names, *(f.name for f in fields)])

    made = source.mapInArrow(run, T.StructType([*[T.StructField(c, f.dataType, True) for f, c in zip(kept, names, strict=True)], *fields]))
    return made.toDF(*[f.name for f in kept], *[f.name for f in fields])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that like has, in its order, whatever their names."""
    return df.select(*[F.col(_quoted(c)) for c in like.columns])
