"""Degenerate sequences as rows: each expansion is made from its number, so that none is held with others in an array.

The letters of a sequence are digits of a mixed radix: the first one counts fastest, and each has as many values as its
letter stands for. A sequence becomes ranges of numbers, which may go to many tasks, and a range the rows of its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import bases_by_letter

#: Numbers of a range.
RANGE = 1 << 16


def _options(seq: Column) -> Column:
    """array of the letters' bases, as texts; null if the sequence is null or holds a letter that is no base."""
    known = F.create_map(*[x for c, v in bases_by_letter().items() for x in (F.lit(c), F.lit(v))])
    found = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: known[c])
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)


def degenerate_count(seq: Column) -> Column:
    """How many sequences a degenerate one stands for; null where it holds another letter, or where they are more than 2**63 - 1."""
    return F.aggregate(_options(seq), F.lit(1).cast("long"), lambda n, x: F.try_multiply(n, F.length(x).cast("long")))


def expanded(df: DataFrame, seq: str = "seq", size: int = RANGE, tasks: int = 0) -> DataFrame:
    """df's rows without the sequence, once for each sequence that it stands for, with the columns idx (from 0, the first letter
    counting fastest) and seq.

    Null sequences and those with other letters give no rows; an empty one gives itself. More than 2**63 - 1 are an error. Ranges of
    size numbers are dealt to so many tasks, if that is asked.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != seq]
    options, n = _options(F.col(f"`{seq}`")), degenerate_count(F.col(f"`{seq}`"))
    start = F.struct(F.lit(1).cast("long").alias("weight"), F.array().cast("array<struct<bases:string,weight:bigint>>").alias("digits"))
    digits = F.aggregate("__options", start, lambda s, x: F.struct((s["weight"] * F.length(x)).cast("long").alias("weight"), F.concat(s["digits"], F.array(F.struct(x.alias("bases"), s["weight"].alias("weight")))).alias("digits")), lambda s: s["digits"])
    rows = df.select(*kept, options.alias("__options"), n.alias("__n")).where("__options IS NOT NULL")
    rows = rows.withColumn("__n", F.coalesce("__n", F.raise_error(F.lit("a sequence stands for too many")).cast("long"))).withColumn("__digits", digits)
    ranges = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(size).cast("long")))).drop("__options")
    ranges = ranges.repartition(tasks) if tasks else ranges
    numbers = ranges.withColumn("idx", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + size, F.col("__n")) - 1)))
    letter = lambda x: F.substr(x["bases"], (F.call_function("div", F.col("idx"), x["weight"]) % F.length(x["bases"]) + 1).cast("int"), F.lit(1))
    return numbers.select(*kept, "idx", F.array_join(F.transform("__digits", letter), "").alias("seq"))
