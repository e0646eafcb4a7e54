"""Operator 2: mixing sources to target weights by temperature.

A source's token share p becomes the weight p**a / sum(p**a). The exponent a (1: as in the corpus, 0: all sources
alike) is bisected until the weights' entropy reaches a target share of the greatest possible one, then raised, if
need be, until no source is read more than MOST times. The weights times the budget are the sources' token budgets.
They are realised as block permutations: every pass over a source visits its blocks in a new random order and the
documents of a block in a new random order, until the budget is used up.

Everything here is made of DataFrame functions; the driver sees sums over sources only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Target: entropy of the weights as a share of the logarithm of the number of sources; times that a source is read at most.
ENTROPY, MOST = 0.97, 4.0
#: Documents of a block of a source, about.
BLOCK = 1024
#: Hexadecimal digits of a block's key that name its sheaf (16 of them: 4096), and sources up to which their table is broadcast.
SHEAF_DIGITS, SMALL = 3, 50_000
#: Halvings of the exponent's interval; LEVELS of them are looked at in one job.
HALVINGS, LEVELS = 40, 4


def tokens(text: Column) -> Column:
    """Words between blanks; an empty or null text has none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def bisected(sources: DataFrame, fits: Callable[[Column, float], Column], lo: float = 0.0, hi: float = 1.0) -> float:
    """The least exponent from lo to hi, to HALVINGS halvings, from which on fits(share, exponent), an aggregate, is true.

    fits must turn from false to true at most once on the way up. One job looks at all 2**LEVELS - 1 midpoints that
    the next LEVELS halvings can reach.
    """
    if sources.agg(fits(F.col("share"), lo).alias("ok")).first().ok:
        return lo
    for _ in range(HALVINGS // LEVELS):
        parts = 1 << LEVELS
        points = [lo + (hi - lo) * k / parts for k in range(1, parts)]
        row = sources.agg(*[fits(F.col("share"), a).alias(f"p{k}") for k, a in enumerate(points)]).first()
        k = next((k for k in range(parts - 1) if row[k]), parts - 1)
        lo, hi = ([lo, *points][k], [*points, hi][k])
    return hi


def entropy(share: Column, a: float) -> Column:
    """Entropy of the weights share**a / sum, as an aggregate over sources."""
    z = F.sum(F.pow(share, F.lit(a)))
    return F.log(z) - F.lit(a) * F.sum(F.pow(share, F.lit(a)) * F.log(share)) / z


def weights(counted: DataFrame, target_entropy: float = ENTROPY, most: float = MOST, budget: int | None = None) -> DataFrame:
    """One row for each source with tokens: source, docs, tokens, share, weight, budget (tokens), exponent.

    counted: source, tokens. budget: tokens of the mix; by default as many as there are; one that is more than most times the
    tokens is an error, as no weights keep that limit. Sources that are null form one source; sources without a token get no
    budget and are left out. Equal shares get equal weights.
    """
    sources = counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    sources = written(sources)
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.n:
        return sources.select("source", "docs", "tokens", *[F.lit(0.0).alias(c) for c in ("share", "weight")], F.lit(0).cast("long").alias("budget"), F.lit(1.0).alias("exponent"))
    budget = total.t if budget is None else budget
    if budget > most * total.t:
        raise ValueError(f"a budget of {budget} tokens reads {total.t} tokens more than {most} times")
    shared = sources.withColumn("share", F.col("tokens") / F.lit(total.t))
    # Entropy falls as the exponent rises: the greatest exponent that still reaches the target.
    falls = lambda p, a: entropy(p, a) < F.lit(target_entropy) * F.log(F.lit(float(total.n))) - 1e-12
    level = bisected(shared, falls)
    read = lambda p, a: F.max(F.pow(p, F.lit(a - 1))) / F.sum(F.pow(p, F.lit(a))) * F.lit(budget / total.t) <= most
    exponent = max(level, bisected(shared, read)) if total.n > 1 else 1.0
    scale = shared.agg(F.sum(F.pow("share", F.lit(exponent))).alias("z")).first().z
    weight = F.pow("share", F.lit(exponent)) / F.lit(scale)
    return shared.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget))).cast("long")).withColumn("exponent", F.lit(float(exponent)))


def _small(plan: DataFrame, rows: int) -> DataFrame:
    """A table of a row for each source, broadcast unless there are too many: then the join is Spark's to choose."""
    return F.broadcast(plan) if rows <= SMALL else plan


def _key(*parts: Column | str) -> Column:
    """A random key that depends on the parts only; a null part counts as the sign that no text holds."""
    return F.md5(F.concat_ws("/", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("\x01")) for p in parts]).cast("binary"))


def _block(doc_key: Column, blocks: str) -> Column:
    return F.pmod(F.conv(F.substring(doc_key, 1, 8), 16, 10).cast("long"), F.col(blocks))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, **targets: float) -> DataFrame:
    """docs' rows as often as the mix reads them, with the columns mix_pass (from 1), mix_block, mix_tokens,
    mix_weight and mix_key; a source's mix is read in the order of mix_pass and mix_key.

    A document is read once in each full pass over its source, and once in the last pass if its tokens and those of
    all that precede it there fit into the rest of the budget. No rest: no last pass. Rows of equal id and source
    share their place: all are read there or none. Sources without tokens are left out; an empty table stays empty; texts
    are counted whole, whatever their length. Columns of docs stay; those of the names above are replaced.
    """
    own = ["mix_pass", "mix_block", "mix_tokens", "mix_weight", "mix_key"]
    docs = docs.drop(*own)
    slim = written(docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), tokens(F.col(text)).alias("tokens")))
    plan = weights(slim.select("source", "tokens"), **targets).select(
        F.col("source").alias("of"), "weight", (F.col("docs") / BLOCK).cast("long").alias("more"), F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    plan = written(plan.withColumn("blocks", F.col("more") + 1).drop("more"))
    n_sources = plan.count()
    last = slim.join(_small(plan, n_sources), F.col("source").eqNullSafe(F.col("of"))).where("rest > 0").withColumn("pass", F.col("full") + 1)
    last = last.withColumn("block", _block(_key(F.lit(seed), "source", "doc"), "blocks"))
    last = last.withColumn("block_key", _key(F.lit(seed), "source", "pass", "block"))
    # Sums of sheaves of blocks first, then of blocks: only the sheaf and the block in which the budget ends are looked into.
    # A window holds at most 16**SHEAF_DIGITS rows of a source, or the blocks of a sheaf, or the documents of a block.
    sums = last.groupBy("of", "block_key", "rest").agg(F.sum("tokens").alias("size")).withColumn("sheaf", F.substring("block_key", 1, SHEAF_DIGITS))
    sheaves = sums.groupBy("of", "sheaf", "rest").agg(F.sum("size").alias("size"))
    sheaves = sheaves.withColumn("upto", F.sum("size").over(Window.partitionBy("of").orderBy("sheaf")))
    sheaves = sheaves.where("upto > rest and upto - size <= rest").select(F.col("of").alias("end_of"), F.col("sheaf").alias("end_sheaf"), (F.col("upto") - F.col("size")).alias("before"))
    ends = sums.join(_small(sheaves, n_sources), F.col("of").eqNullSafe(F.col("end_of")) & (F.col("sheaf") == F.col("end_sheaf")))
    ends = ends.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("end_of").orderBy("block_key")))
    ends = ends.where("upto > rest and upto - size <= rest").select("end_of", F.col("block_key").alias("end_block"), (F.col("upto") - F.col("size")).alias("before"))
    inside = last.join(_small(ends, n_sources), F.col("of").eqNullSafe(F.col("end_of")) & (F.col("block_key") == F.col("end_block"))).withColumn("doc_key", _key(F.lit(seed), "source", "pass", "doc"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("end_of").orderBy("doc_key")))
    cut = inside.groupBy("end_of", "end_block").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("doc_key"))), F.lit("")).alias("end_doc"))
    plan = written(plan.join(_small(cut, n_sources), F.col("of").eqNullSafe(F.col("end_of")), "left").drop("end_of"))
    plan = plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns})
    # One row for each source meets the documents here; their texts are not shuffled.
    rows = docs.withColumn("mix_tokens", tokens(F.col(text))).join(_small(plan, n_sources), F.col(source).eqNullSafe(F.col("__of")))
    rows = rows.withColumn("mix_block", _block(_key(F.lit(seed), source, doc_id), "__blocks"))
    in_last = F.struct(_key(F.lit(seed), F.col(source), F.col("__full") + 1, F.col("mix_block")), _key(F.lit(seed), F.col(source), F.col("__full") + 1, F.col(doc_id))) <= F.struct("__end_block", "__end_doc")
    passes = F.col("__full") + F.when(F.col("__rest") > 0, F.coalesce(in_last, F.lit(False)).cast("int")).otherwise(0)
    rows = rows.withColumn("__passes", passes).where("__passes > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
    rows = rows.withColumn("mix_key", F.concat(F.substring(_key(F.lit(seed), F.col(source), F.col("mix_pass"), F.col("mix_block")), 1, 12), F.substring(_key(F.lit(seed), F.col(source), F.col("mix_pass"), F.col(doc_id)), 1, 20)))
    return rows.withColumn("mix_weight", F.col("__weight")).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns], *own)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).drop("text").withColumn("mix_weight", F.round("mix_weight", 9))
