"""Operator 13: importance resampling of documents towards a target's distribution of hashed word n-grams.

A position table holds a row for each word of each document. Window lead() puts the following words beside it, one more
for each order, and the runs are hashed into buckets. Buckets are counted over the documents and over the target; a
bucket's gain is the log ratio of its two shares, smoothed by one. Gains are joined to the position table (a row for each
bucket, so their size is bounded) and averaged for each document; with Gumbel noise drawn from the document's id the
highest scores are a sample without replacement, in proportion to exp(weight / 1000).

All is DataFrame functions. Texts are dealt by document before they are cut into words, so that the window needs no
shuffle of words, only a sort within its task that Spark spills. Nothing is collected but two numbers.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, table, written

#: Buckets of features, longest run of words, percent of the documents that are drawn, words that a drawn document has at least.
BUCKETS, ORDERS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Letters that are no part of a word, once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The text's words in order; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), _BETWEEN), "")


def positions(docs: DataFrame, key: str, text: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """docs without its text, a row for each word: b1 is the word's bucket, b2 that of the word and the next one, and so on; null
    where the document ends before. A document without a word has one row of nulls. key names each row of docs apart."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.repartition(key).select(*kept, F.posexplode_outer(words_of(F.col(text))).alias("__pos", "__word"))
    ahead = Window.partitionBy(key).orderBy("__pos")
    gram, out = F.col("__word"), []
    for n in range(1, orders + 1):
        gram = gram if n == 1 else F.concat(gram, F.lit(" "), F.lead("__word", n - 1).over(ahead))
        out.append((F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"b{n}"))
    return rows.select(*kept, *out)


def counts(position: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket, n: summed in every task before they are shuffled."""
    return position.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of the buckets that source or target (bucket, n) hold: floor(1000 ln of the ratio of their smoothed shares)."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_ = Window.partitionBy()  # a row for each bucket
    s, t = (F.sum(c).over(all_).cast("double") + buckets for c in ("s", "t"))
    return both.select("bucket", F.floor(1000 * F.ln((F.col("t") + 1) * s / ((F.col("s") + 1) * t))).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn from the id; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs(doc_id, text), towards target(text).

    Of the N documents of at least least_words words the floor(percent * N / 100) of the highest scores have a rank, from 1;
    ties go to the smaller id (null last); of rows that share it any order of them counts. Null and empty texts have no
    feature and weight 0. Rows that repeat are documents each. Texts are whole. An empty target gives the gains of no target
    word; empty docs give no rows. Other columns do not count, whatever their names. docs is best read from files: the
    numbers that tell its rows apart follow the order in which they are read.
    """
    named = docs.select(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("__key"))
    table_ = written(positions(named, "__key", "text", orders, buckets))
    aims = positions(target.select("text", F.monotonically_increasing_id().alias("__key")), "__key", "text", orders, buckets)
    gain = F.broadcast(gains(counts(table_, orders), counts(aims, orders), buckets))  # a row for each bucket
    columns = [f"b{n}" for n in range(1, orders + 1)]
    rows = table_
    for c in columns:
        rows = rows.join(gain.select(F.col("bucket").alias(c), F.col("gain").alias(f"g{c}")), c, "left")
    n = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    total = sum((F.coalesce(F.sum(f"g{c}"), F.lit(0)) for c in columns[1:]), F.coalesce(F.sum(f"g{columns[0]}"), F.lit(0)))
    per = rows.groupBy("__key").agg(F.first("doc_id").alias("doc_id"), n.alias("n_features"), F.count("b1").alias("n_words"), total.alias("__sum"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("__sum") / F.col("n_features"))).otherwise(0).cast("long")
    scored = written(per.select("__key", "doc_id", "n_features", "n_words", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    allowed = scored.where(F.col("n_words") >= least_words)
    drawn = percent * allowed.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__key").asc()]
    first = ranked(allowed.select("__key", "score", "doc_id"), order, "rank").where(F.col("rank") <= drawn).select("__key", "rank")
    return scored.join(first, "__key", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
