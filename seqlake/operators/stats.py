"""Length statistics of groups: moments, hinges, percentiles, N50 and its kin.

Lengths are counted first (a hash aggregate with map-side sums); only the histogram is sorted. Its running sums are made in
two levels: within ranges of lengths, and over the ranges of a group, so that no window holds more than a range's lengths or
a group's ranges.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of a range.
RANGE = 1 << 16


def histogram(df: DataFrame, length: str, by: list[str], n: str | None = None) -> DataFrame:
    """by, len, n and running sums: upto (lengths counted up to here), total, bases (their sum), sum, over (bases above). n: a column
    that says how often a row counts."""
    number = F.sum(F.col(n).cast("long")) if n else F.count("*")
    counted = df.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).cast("long").alias("len")).agg(number.alias("n"))
    counted = counted.withColumns({"__range": F.floor(F.col("len") / RANGE), "__bases": F.col("len") * F.col("n")})
    ranges = counted.groupBy(*by, "__range").agg(F.sum("n").alias("__n"), F.sum("__bases").alias("__b"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    ranges = ranges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of"), before("__n").alias("__n0"), before("__b").alias("__b0"), F.sum("__n").over(all_).alias("total"), F.sum("__b").over(all_).alias("sum"))
    inside = Window.partitionBy(*by, "__range").orderBy("len")
    placed = counted.select(*by, "len", "n", "__range", F.sum("n").over(inside).alias("upto"), F.sum("__bases").over(inside).alias("bases"))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__range") == F.col("__of"))
    out = placed.join(ranges, same).withColumns({"upto": F.col("upto") + F.col("__n0"), "bases": F.col("bases") + F.col("__b0")})
    return out.select(*by, "len", "n", "upto", "total", "bases", "sum", (F.col("sum") - F.col("bases")).alias("over"))


def _at(place: Column) -> Column:
    """The value at a 0-based place of the sorted lengths, as an aggregate over the histogram."""
    return F.min(F.when(F.col("upto") > place, F.col("len")))


def _middle(start: Column, size: Column) -> Column:
    """The median of so many sorted lengths from a place on."""
    return (_at(start + F.floor((size - 1) / 2)) + _at(start + F.floor(size / 2))) / 2


def _nx(x: float) -> Column:
    """The greatest length that, with all longer ones, makes up x percent of the bases."""
    return F.max(F.when((F.col("over") + F.col("len") * F.col("n")) * 100 >= F.col("sum") * x, F.col("len")))


def length_stats(df: DataFrame, length: str = "length", by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """count, sum, min, max, mean, q1, median, q3, n50, l50 and l50_distinct of each group.

    q1 and q3 are Tukey's hinges: medians of the lower and upper half, both with the middle value if the number is odd.
    l50: how many of the longest sequences make up half of the bases. l50_distinct: how many different lengths do.
    Null lengths do not count. n: a column that says how often a row counts (a histogram's). Without groups and rows: count 0 and
    zeros, mean null.
    """
    by = by or []
    h = histogram(df, length, by, n)
    n, half = F.col("total"), F.ceil(F.col("total") / 2)
    marked = h.withColumn("longer", F.col("total") - F.col("upto")).withColumn("in_n50", F.col("over") * 2 < F.col("sum"))
    # Of the lengths in N50's class just so many as are needed to reach half of the bases.
    needed = F.col("longer") + F.least(F.col("n"), F.ceil((F.col("sum") / 2 - F.col("over")) / F.greatest(F.col("len"), F.lit(1))))
    zero = lambda c: c if by else F.coalesce(c, F.lit(0))
    return marked.groupBy(*by).agg(
        zero(F.sum("n")).cast("long").alias("count"),
        zero(F.max("sum")).cast("long").alias("sum"),
        zero(F.min("len")).alias("min"),
        zero(F.max("len")).alias("max"),
        (F.max("sum") / F.max("total")).alias("mean"),
        zero(_middle(F.lit(0), half)).cast("double").alias("q1"),
        zero(_middle(F.lit(0), n)).cast("double").alias("median"),
        zero(_middle(n - half, half)).cast("double").alias("q3"),
        zero(_nx(50)).alias("n50"),
        zero(F.max(F.when(F.col("in_n50"), needed))).cast("long").alias("l50"),
        zero(F.count(F.when(F.col("in_n50"), 1))).cast("long").alias("l50_distinct"),
    )


def nx_lx(df: DataFrame, x: float, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """nx and lx of each group: as N50 and L50, at x percent (0 to 100)."""
    if not 0 <= x <= 100:
        raise ValueError(f"x must be from 0 to 100: {x}")
    by = by or []
    h = histogram(df, length, by).withColumn("longer", F.col("total") - F.col("upto"))
    inside = F.col("over") * 100 < F.col("sum") * x
    needed = F.col("longer") + F.least(F.col("n"), F.ceil((F.col("sum") * x / 100 - F.col("over")) / F.greatest(F.col("len"), F.lit(1))))
    return h.groupBy(*by).agg(_nx(x).alias("nx"), F.coalesce(F.max(F.when(inside, needed)), F.lit(0)).cast("long").alias("lx"))


def percentile(df: DataFrame, p: float, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """The p-th percentile (0 < p <= 100) of each group: the value at n*p/100 if that is a whole number, else the mean of
    the two around it; the smallest where that place is below 1."""
    if not 0 < p <= 100:
        raise ValueError(f"p must be over 0 and at most 100: {p}")
    by = by or []
    place = F.col("total") * p / 100
    whole = F.abs(place - F.round(place)) < 0.001
    i = F.floor(place)
    value = F.when(F.max(F.when(whole, F.round(place))) > 0, _at(F.round(place) - 1)).when(F.max(i) < 1, F.min("len")).otherwise((_at(i - 1) + _at(i)) / 2)
    return histogram(df, length, by).groupBy(*by).agg(value.cast("double").alias("percentile"))


def byte_histogram(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """by, letter, n: how often each letter occurs."""
    letters = df.select(*(by or []), F.explode(F.split(F.col(text), "")).alias("letter")).where("letter <> ''")
    return letters.groupBy(*(by or []), "letter").agg(F.count("*").alias("n"))
