"""GTF and BED features from text lines, as column expressions: filters act before numbers are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _must(text: Column, kind: str, what: str) -> Column:
    """The number in a text; anything else is an error."""
    return F.coalesce(text.try_cast(kind), F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(text, F.lit("null")))).cast(kind))


def parse_gtf(lines: DataFrame, chromosomes: list[str] | None = None, features: list[str] | None = None, attributes: list[str] | None = None) -> DataFrame:
    """seqname, source, feature, start, end, score, strand, frame, attributes of GTF lines (column value).

    Comments, empty lines and lines that do not have nine columns are left out. Chromosomes and features are filtered
    whatever their case; attributes (all, unless some are named) keep their order and may repeat. Places are 1-based and
    closed; start and end are swapped on the - strand if they are the wrong way round, and an error on the + strand.
    A score or frame of '.' is null. Bad numbers, strands and frames are errors.
    """
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).withColumn("p", p).where(F.size("p") == 9)
    if chromosomes:
        rows = rows.where(F.lower(F.col("p")[0]).isin([c.lower() for c in chromosomes]))
    if features:
        rows = rows.where(F.lower(F.col("p")[2]).isin([c.lower() for c in features]))
    c = [F.col("p")[i] for i in range(9)]
    strand = F.when(c[6].isin("+", "-", "."), c[6]).otherwise(F.raise_error(F.concat(F.lit("bad strand: "), c[6])).cast("string"))
    start, end = _must(c[3], "int", "start"), _must(c[4], "int", "end")
    swap = (c[6] == "-") & (start > end)
    first = F.when(swap, end).when((c[6] == "+") & (start > end), F.raise_error(F.lit("start is over end on the + strand")).cast("int")).otherwise(start)
    frame = F.when(c[7] == ".", F.lit(None).cast("int")).when(c[7].isin("0", "1", "2"), c[7].try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad frame: "), c[7])).cast("int"))
    score = F.when(c[5] == ".", F.lit(None).cast("double")).otherwise(_must(c[5], "double", "score"))
    pieces = F.filter(F.transform(F.split(c[8], ";(?: |$)"), F.trim), lambda x: x != "")
    pairs = F.transform(pieces, lambda x: F.struct(F.substring_index(x, " ", 1).alias("tag"), F.regexp_replace(F.regexp_extract(x, r"^[^ ]* +(.*)$", 1), '^"|"$', "").alias("value")))
    if attributes:
        pairs = F.filter(pairs, lambda a: F.lower(a["tag"]).isin([x.lower() for x in attributes]))
    return rows.select(c[0].alias("seqname"), c[1].alias("source"), c[2].alias("feature"), first.alias("start"), F.when(swap, start).otherwise(end).alias("end"), score.alias("score"), strand.alias("strand"), frame.alias("frame"), pairs.alias("attributes"))


def read_gtf(spark: SparkSession, path: str, **filters: list[str]) -> DataFrame:
    return parse_gtf(spark.read.text(path), **filters)


BED_COLUMNS = ["chrom", "chrom_start", "chrom_end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "block_count", "block_sizes", "block_starts"]


def parse_bed(lines: DataFrame, n: int = 3) -> DataFrame:
    """BED lines (column value) with their first n columns (3, 4, 5, 6 or 12), and length; places are 0-based, half open.

    Comments, browser and track lines are left out; more columns are ignored, fewer are an error, and so are bad numbers.
    A strand of '.' is null. Of block lists the first block_count entries count.
    """
    if n not in (3, 4, 5, 6, 12):
        raise ValueError(f"no BED type of {n} columns")
    rows = lines.where(~F.rlike("value", F.lit(r"^(#|browser\b|track\b|\s*$)"))).withColumn("p", F.split(F.regexp_replace("value", "\r$", ""), "\t"))
    c = [F.get("p", F.lit(i)) for i in range(12)]
    enough = F.size("p") >= n
    number = lambda i: _must(c[i], "int", BED_COLUMNS[i])
    blocks = lambda i: F.transform(F.slice(F.split(c[i], ","), 1, number(9)), lambda x: _must(F.trim(x), "int", BED_COLUMNS[i]))
    all_ = [
        F.when(enough, c[0]).otherwise(F.raise_error(F.concat(F.lit(f"not BED{n}: "), F.col("value"))).cast("string")), number(1), number(2), c[3], number(4), F.nullif(c[5], F.lit(".")), number(6), number(7), c[8], number(9), blocks(10), blocks(11),
    ]
    out = rows.select(*[x.alias(name) for x, name in zip(all_[:n], BED_COLUMNS, strict=False)])
    return out.withColumn("length", F.col("chrom_end") - F.col("chrom_start"))


def track_lines(lines: DataFrame) -> DataFrame:
    """The settings of BED track lines: one map for each."""
    found = F.regexp_extract_all("value", F.lit(r"(\w+=(?:\"[^\"]*\"|'[^']*'|[^ ]+))"), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, "^[^=]*=(.*)$", 1), "^[\"']|[\"']$", "").alias("v")))
    return lines.where(F.startswith("value", F.lit("track"))).select(F.map_from_entries(pairs).alias("track"))


def read_bed(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    return parse_bed(spark.read.text(path), n)


def format_bed(df: DataFrame, n: int = 3) -> DataFrame:
    """One column value of BED lines, for df.write.text; a null strand becomes '.'."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) if c in ("block_sizes", "block_starts") else F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", *[text(c) for c in BED_COLUMNS[:n]]).alias("value"))


def overlaps(a: DataFrame, b: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Extension: pairs of overlapping BED features, by an equi-join on bins of the genome. Columns of b get the suffix _b.

    Every feature goes to all bins it touches; a pair is given in the bin where the overlap begins only.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    left = a.withColumn("__bin", bins("chrom_start", "chrom_end"))
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]).withColumn("__bin_b", bins("chrom_start_b", "chrom_end_b"))
    hit = (F.col("chrom") == F.col("chrom_b")) & (F.col("__bin") == F.col("__bin_b")) & (F.col("chrom_start") < F.col("chrom_end_b")) & (F.col("chrom_start_b") < F.col("chrom_end"))
    return left.join(right, hit).where(F.floor(F.greatest("chrom_start", "chrom_start_b") / width) == F.col("__bin")).drop("__bin", "__bin_b")
