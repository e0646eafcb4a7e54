"""Operator 5: document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (line-separated, each cut further behind sentence ends). Every paragraph is
hashed (SHA-256) to a wide vector: LANES lanes of 32 bits, and one of SLOTS slots with a sign. A fingerprint is the sum
of its paragraphs' vectors: modulo 2**32 in every lane, and of the signs in every slot. Sums do not depend on order, and
adding or subtracting a paragraph's vector inserts or deletes it without the rest of the text. Lanes tell equal texts;
the slots' signed sums are a sketch whose products estimate how many paragraphs two texts share, with an error of about
1 / sqrt(SLOTS) however long the texts are.

Everything here is made of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LANES, SLOTS = 8, 256
MODULUS = 1 << 32
#: Ids that differ in so many last bits only form a range, in which each row looks for the next. Ranges that differ in so many
#: bits are grouped in the same way, level by level.
RANGE_BITS, GROUP_BITS, LEVELS = 9, 11, 5
#: Rows without an id are dealt to so many ranges behind all others.
NULL_RANGES, NULL_FIRST = 1 << 20, -(1 << 62)


def paragraphs(text: Column) -> Column:
    """The text's paragraphs as an array: none are empty, and spaces around them do not count."""
    text = F.coalesce(text, F.lit(""))
    for sign in ".!?":
        text = F.replace(text, F.lit(sign + " "), F.lit(sign + "\n"))
    return F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def paragraph_vector(paragraph: Column) -> Column:
    """LANES lanes of 32 bits from the paragraph's SHA-256."""
    digest = F.sha2(paragraph.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)])


def slot_of(last_lane: Column) -> tuple[Column, Column]:
    """A paragraph's slot and its sign there, 1 or -1."""
    return F.pmod(last_lane, F.lit(SLOTS)), F.pmod(F.floor(last_lane / SLOTS), F.lit(2)) * 2 - 1


def added(lanes: Column, vector: Column, sign: int = 1) -> Column:
    """Lanes with a vector inserted (sign 1) or deleted (-1)."""
    return F.zip_with(lanes, vector, lambda a, b: F.pmod(a + sign * b, F.lit(MODULUS)))


def prints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and print, a struct of lanes and slots (slot, value; none of value 0), of every group of keys: the sum over its texts.

    Null and empty texts have no paragraphs: lanes of 0, no slots. Very long texts are rows of paragraphs, not arrays of
    vectors. Where texts is partitioned by some of the keys already, nothing is shuffled.
    """
    digest = F.sha2(F.col("__p").cast("binary"), 256)
    rows = texts.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("__p")).withColumn("__p", digest)
    lane = [f"l{i}" for i in range(LANES)]
    rows = rows.select(*keys, *[F.conv(F.substring("__p", 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(lane)])
    slot, sign = slot_of(F.col(lane[-1]))
    slots = rows.groupBy(*keys, slot.alias("slot")).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in lane], F.sum(sign).alias("value"))
    filled = F.filter(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value")))), lambda x: x["value"] != 0)
    summed = slots.groupBy(*keys).agg(F.array(*[F.pmod(F.sum(F.pmod(x, F.lit(MODULUS))), F.lit(MODULUS)) for x in lane]).alias("lanes"), filled.alias("slots"))
    return summed.select(*keys, F.struct("lanes", "slots").alias("print"))


def as_text(print_: Column) -> Column:
    """The fingerprint as text: the lanes, then every slot in use and its sum modulo 2**32, in hexadecimal."""
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(print_["lanes"], lambda x: hexed(x, 8)), ""), F.lit(":"), F.array_join(F.transform(print_["slots"], lambda p: F.concat(hexed(p["slot"], 2), hexed(F.pmod(p["value"], F.lit(MODULUS)), 8))), ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal lanes; else the cosine of the slots' sums (0 at least, and where either has none)."""
    add = lambda s, x: s + x
    norm = lambda p: F.sqrt(F.aggregate(F.transform(p["slots"], lambda x: x["value"] * x["value"]), F.lit(0).cast("long"), add).cast("double"))

    def dot(of_b: Column) -> Column:
        return F.aggregate(F.transform(a["slots"], lambda x: x["value"] * F.coalesce(F.try_element_at(of_b, x["slot"]), F.lit(0))), F.lit(0).cast("long"), add)

    product = F.element_at(F.transform(F.array(F.map_from_entries(b["slots"])), dot), 1).cast("double")
    none = (F.size(a["slots"]) == 0) | (F.size(b["slots"]) == 0)
    return F.when(a["lanes"] == b["lanes"], F.lit(1.0)).when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), product / (norm(a) * norm(b)))))


def following(keys: DataFrame, level: int = 0) -> DataFrame:
    """(of, next): for every value of keys(k), all different, the next smaller one; the greatest follows the smallest.

    Values that agree but for their last GROUP_BITS are looked at together, and what comes behind each such group is found in
    the same way among the groups. No window holds more than 2**GROUP_BITS values.
    """
    if level == LEVELS - 1:  # what is left of 64 bits is few values
        all_ = Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc())
        return keys.select(F.col("k").alias("of"), F.coalesce(F.lead("k").over(all_), F.first("k").over(all_)).alias("next"))
    grouped = keys.withColumn("g", F.shiftright("k", GROUP_BITS))
    linked = grouped.withColumn("next", F.lead("k").over(Window.partitionBy("g").orderBy(F.col("k").desc())))
    greatest = grouped.groupBy("g").agg(F.max("k").alias("first"))
    behind = following(greatest.select(F.col("g").alias("k")), level + 1).join(greatest, F.col("next") == F.col("g")).select(F.col("of").alias("g"), "first")
    return linked.join(behind, "g").select(F.col("k").alias("of"), F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """range, place, doc_id, text, next_text of the next row by descending doc_id, and head, true if that is of another range.

    After the last row comes the first again. Rows of equal id follow each other by text; null ids come last, by a hash of the
    text. Rows are dealt by ranges of ids, once. The last row of a range takes the head of the next range that has rows: of
    each range one head moves.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    of_null = F.conv(F.substring(F.md5(body.cast("binary")), 1, 5), 16, 10).cast("long") + NULL_FIRST
    range_ = F.coalesce(F.shiftright(F.col(doc_id).cast("long"), RANGE_BITS), of_null)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), range_.alias("range"))
    inner = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    linked = rows.withColumns({"next": F.lead("text").over(inner), "place": F.row_number().over(inner)})
    follows = following(rows.select(F.col("range").alias("k")).distinct())
    # The heads come from the same deal of rows; only they move to the range before.
    heads = linked.where("place = 1").select(F.col("range").alias("next"), F.col("text").alias("first")).join(follows, "next").select(F.col("of").alias("range"), "first")
    return linked.join(heads, "range", "left").select("range", "place", "doc_id", "text", F.coalesce("next", "first").alias("next_text"), F.col("next").isNull().alias("head"))


def edited(text: Column, following_: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following_, half))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its fingerprint, its edited text's, and their likeness to each other and to the next row's.

    Null texts count as empty; a single row is its own next; equal texts have equal fingerprints, and rows that repeat are
    kept each. An empty table gives no rows; other columns of docs do not count. The next row's fingerprint is taken from
    that row, and only the last row of a range makes it anew.
    """
    rows = with_next(docs, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["range", "place", "doc_id", "n_chars", "edited_sha256"]
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("kind"), F.when(F.col("head"), F.col("next_text")).alias("t")))
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    each = prints(rows.select(*keys, F.inline(F.filter(texts, lambda x: x["t"].isNotNull()))), [*keys, "kind"], "t")
    of = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("print")), ignorenulls=True)
    whole = each.groupBy(*keys).agg(of(0).alias("print"), of(1).alias("edited_print"), of(2).alias("head_print"))
    after = F.lead("print").over(Window.partitionBy("range").orderBy("place"))
    whole = whole.withColumn("next_print", F.coalesce("head_print", after))
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
