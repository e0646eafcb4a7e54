"""Driver bindings of the library's own operators: each query, and the SQL that an independent engine runs for it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codons, quality
from .functions import sequence as sq
from .operators import expansions, sketches, stats, table_functions
from .plans.derived import qualities, sequences, table
from .plans.derived import taxonomy as tree
from .session import shared_path
from .sources import blocks, datasource, fai, fastx, features, speculative

SEQ = "(SELECT doc_id, source, lang, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS seq FROM documents)"
QUAL = "(SELECT doc_id, lang, regexp_replace(text, '[^!-~]', '', 'g') AS qual FROM documents)"
REVCOM = "reverse(translate({}, 'acgtACGT', 'tgcaTGCA'))"
#: Bytes of a split of the files that queries write and read in splits.
SPLIT = 1 << 18
RANGES = [(1, 1), (2, 4), (-4, -2), (-1, -1), (2, -2), (12, 14), (-10, -3), (3, 100), (-4, 2), (0, 0)]


# composition, ranges, windows


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("length"))
    return stats.length_stats(docs, by=["source"])


_SORTED = """s AS (SELECT source, n_chars AS len, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
 sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER (PARTITION BY source) AS tot,
 row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)"""
LENGTH_STATS = f"""WITH {_SORTED}
SELECT source, count(*)::BIGINT AS "count", max(tot)::BIGINT AS "sum", min(len) AS "min", max(len) AS "max", max(tot) / count(*) AS mean,
 avg(CASE WHEN i = ((n + 1) // 2 - 1) // 2 THEN len END) / 2 + avg(CASE WHEN i = ((n + 1) // 2) // 2 THEN len END) / 2 AS q1,
 avg(CASE WHEN i = (n - 1) // 2 THEN len END) / 2 + avg(CASE WHEN i = n // 2 THEN len END) / 2 AS median,
 avg(CASE WHEN i = n - (n + 1) // 2 + ((n + 1) // 2 - 1) // 2 THEN len END) / 2 + avg(CASE WHEN i = n - (n + 1) // 2 + ((n + 1) // 2) // 2 THEN len END) / 2 AS q3,
 max(CASE WHEN run * 2 >= tot THEN len END) AS n50, min(CASE WHEN run * 2 >= tot THEN place END)::BIGINT AS l50,
 count(DISTINCT CASE WHEN (run - len) * 2 < tot THEN len END)::BIGINT AS l50_distinct FROM s GROUP BY source"""


def nx_lx(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("length"))
    return stats.nx_lx(docs, 90, by=["source"])


NX_LX = f"""WITH {_SORTED} SELECT source, max(CASE WHEN run * 100 >= tot * 90 THEN len END) AS nx, min(CASE WHEN run * 100 >= tot * 90 THEN place END)::BIGINT AS lx FROM s GROUP BY source"""


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("length"))
    return stats.percentile(docs, 90, by=["lang"])


def percentile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").alias("length"))
    per = [stats.percentile(docs, p, by=["lang"]).select(F.lit("percentile").alias("kind"), F.lit(float(p)).alias("p"), F.col("lang").alias("of"), F.col("percentile").alias("value"), F.lit(0).cast("long").alias("lx")) for p in GRID]
    nx = [stats.nx_lx(docs, x, by=["source"]).select(F.lit("nx").alias("kind"), F.lit(float(x)).alias("p"), F.col("source").alias("of"), F.col("nx").cast("double").alias("value"), "lx") for x in GRID]
    return functools.reduce(DataFrame.unionByName, per + nx)


#: Percents at which percentiles, NX and LX are taken.
GRID = [1, 5, 25, 50, 75, 99, 100]
PERCENTILE_GRID = f"""WITH p AS (SELECT unnest({GRID}) AS p), s AS (SELECT lang, n_chars AS len, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 x AS (SELECT source, n_chars AS len, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER (PARTITION BY source) AS tot, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT 'percentile' AS kind, p::DOUBLE AS p, lang AS "of", CASE WHEN max(n) * p % 100 = 0 THEN max(CASE WHEN i = n * p // 100 - 1 THEN len END)::DOUBLE
 WHEN max(n) * p // 100 < 1 THEN min(len)::DOUBLE ELSE (max(CASE WHEN i = n * p // 100 - 1 THEN len END) + max(CASE WHEN i = n * p // 100 THEN len END)) / 2 END AS value, 0::BIGINT AS lx FROM s, p GROUP BY lang, p
UNION ALL SELECT 'nx', p::DOUBLE, source, max(CASE WHEN run * 100 >= tot * p THEN len END)::DOUBLE, min(CASE WHEN run * 100 >= tot * p THEN place END)::BIGINT FROM x, p GROUP BY source, p"""
PERCENTILES = """WITH s AS (SELECT lang, n_chars AS len, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CASE WHEN max(n) * 90 % 100 = 0 THEN max(CASE WHEN i = n * 90 // 100 - 1 THEN len END)::DOUBLE
 WHEN max(n) * 90 // 100 < 1 THEN min(len)::DOUBLE ELSE (max(CASE WHEN i = n * 90 // 100 - 1 THEN len END) + max(CASE WHEN i = n * 90 // 100 THEN len END)) / 2 END AS percentile FROM s GROUP BY lang"""


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return sequences(spark, sf_dir).select("doc_id", F.length(s).alias("n"), sq.base_count(s, "gc").alias("n_gc"), sq.base_count(s, "A", case_sensitive=True).alias("n_upper_a"), F.round(sq.gc(s), 9).alias("gc"))


BASE_COMPOSITION = f"""SELECT doc_id, length(seq)::INT AS n, (length(seq) - length(regexp_replace(seq, '[gcGC]', '', 'g')))::INT AS n_gc, (length(seq) - length(replace(seq, 'A', '')))::INT AS n_upper_a,
 round(CASE WHEN length(seq) = 0 THEN 0 ELSE (length(seq) - length(regexp_replace(seq, '[gcsGCS]', '', 'g'))) / length(seq) END, 9) AS gc FROM {SEQ}"""


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", sq.revcom(F.col("seq")).alias("revcom"), sq.complement(F.col("seq")).alias("complement"))


REVERSE_COMPLEMENT = f"SELECT doc_id, {REVCOM.format('seq')} AS revcom, translate(seq, 'acgtACGT', 'tgcaTGCA') AS complement FROM {SEQ}"


def sub_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in RANGES])
    rows = sequences(spark, sf_dir).select("doc_id", "seq", F.inline(ranges))
    return rows.select("doc_id", "a", "b", sq.sub_seq(F.col("seq"), F.col("a"), F.col("b")).alias("sub"))


def _range_sql(below: str) -> str:
    values = ", ".join(f"({a}, {b})" for a, b in RANGES)
    return f"""WITH r(a, b) AS (VALUES {values}), x AS (SELECT doc_id, seq, a, b, length(seq) AS n, CASE a WHEN 0 THEN 1 ELSE a END AS a0, CASE b WHEN 0 THEN -1 ELSE b END AS b0 FROM {SEQ}, r),
 y AS (SELECT *, CASE WHEN a0 < -n THEN 1 WHEN a0 < 0 THEN n + a0 + 1 ELSE a0 END AS s, CASE WHEN b0 > n THEN n WHEN b0 < 0 THEN n + b0 + 1 ELSE b0 END AS e FROM x)
SELECT doc_id, a, b, CASE WHEN n > 0 AND NOT (a0 < 0 AND b0 < 0 AND a0 > b0) AND a0 <= n AND s - 1 <= e{below} THEN substr(seq, s, (e - s + 1)::INT) ELSE '' END AS sub FROM y"""


#: What is kept of a document's letters by the remainder of its id, so that every alphabet is met.
KEPT = ["ACGTNacgtn .-", "ACGUNacgun .-", "ACGTRYSWKMBDHVNacgtryswkmbdhvn .-", "ACGURYSWKMBDHVNacguryswkmbdhvn .-", "A-Za-z *_-"]


def gaps_and_alphabets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, kind = F.col("text"), F.col("doc_id") % (len(KEPT) + 1)
    seq = t
    for i, letters in enumerate(KEPT):
        seq = F.when(kind == i, F.regexp_replace("text", f"[^{letters}]", "")).otherwise(seq)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", seq.alias("seq"))
    return rows.select("doc_id", sq.remove_gaps(F.col("seq")).alias("clean"), sq.bases(F.col("seq")).alias("bases"), sq.guess_alphabet(F.col("seq")).alias("guess"), sq.is_valid(t, "Protein").alias("protein"), sq.first_invalid(t, "Protein").alias("bad"))


_GUESSES = " ".join(f"WHEN regexp_full_match(h, '[{c}]*') THEN '{name}'" for c, name in zip([*KEPT[:4], "A-Za-z *_.-"], ("DNA", "RNA", "DNAredundant", "RNAredundant", "Protein"), strict=True))
GAPS_AND_ALPHABETS = f"""WITH d AS (SELECT doc_id, text AS t, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN regexp_replace(text, '[^{c}]', '', 'g')" for i, c in enumerate(KEPT))} ELSE text END AS seq FROM documents), e AS (SELECT *, substr(seq, 1, 10000) AS h FROM d)
SELECT doc_id, regexp_replace(seq, '[ .-]', '', 'g') AS clean, length(regexp_replace(seq, '[ .-]', '', 'g'))::INT AS bases,
 CASE WHEN h = '' THEN 'Unlimit' {_GUESSES} ELSE 'Unlimit' END AS guess, regexp_full_match(t, '[A-Za-z *_.-]*') AS protein, nullif(regexp_extract(t, '[^A-Za-z *_.-]'), '') AS bad FROM e"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", F.inline(sq.slider(F.col("seq"), 30, 25, greedy=True))).withColumnRenamed("seq", "part")


WINDOWS = f"""SELECT doc_id, i::INT AS "start", substr(seq, i + 1, 30) AS part FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 25)) AS i FROM {SEQ})"""


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.regexp_replace(F.upper("text"), "[^ACGTRYN]", "")
    few = F.regexp_replace("text", "[^acgt]", "")
    for i, letters in enumerate(("ac", "agt", "ct", "g")):
        few = F.when(F.col("doc_id") % 5 == i, F.regexp_replace("text", f"[^{letters}]", "")).otherwise(few)
    return table(spark, sf_dir, "documents").select("doc_id", sq.degenerate_regexp(s).alias("pattern"), sq.ambiguous_base(few).alias("amb"))


DEGENERATE = """SELECT doc_id, replace(replace(replace(replace(regexp_replace(upper(text), '[^ACGTRYN]', '', 'g'), 'T', '[TU]'), 'R', '[AG]'), 'Y', '[C<U]'), 'N', '[ACG<U]')
 .replace('<', 'T') AS pattern, substr('-ACMGRSVTWYHKDBN', 1 + (CASE WHEN contains(b, 'a') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'c') THEN 2 ELSE 0 END + CASE WHEN contains(b, 'g') THEN 4 ELSE 0 END + CASE WHEN contains(b, 't') THEN 8 ELSE 0 END), 1) AS amb
 FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN regexp_replace(text, '[^ac]', '', 'g') WHEN 1 THEN regexp_replace(text, '[^agt]', '', 'g') WHEN 2 THEN regexp_replace(text, '[^ct]', '', 'g') WHEN 3 THEN regexp_replace(text, '[^g]', '', 'g') ELSE text END AS b FROM documents)"""


def expansions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences that the documents' words of 3 to 8 degenerate letters stand for: a row each."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[^a-z]+")).alias("seq"))
    return expansions.expanded(words.where(F.rlike("seq", F.lit("^[acgtnry]{3,8}$"))))


EXPANSIONS = """WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^a-z]+')) AS s FROM documents) WHERE regexp_full_match(s, '[acgtnry]{3,8}')),
 o(c, bases) AS (VALUES ('a', ['a']), ('c', ['c']), ('g', ['g']), ('t', ['t', 'u']), ('r', ['a', 'g']), ('y', ['c', 't', 'u']), ('n', ['a', 'c', 'g', 't', 'u'])),
 e(doc_id, k, s, i, idx, w, seq) AS (SELECT doc_id, k, s, 0, 0::BIGINT, 1::BIGINT, '' FROM d
  UNION ALL SELECT doc_id, k, s, i + 1, idx + w * b, w * len(bases), seq || bases[b + 1] FROM (SELECT e.*, o.bases, unnest(range(len(o.bases))) AS b FROM e JOIN o ON o.c = substr(s, i + 1, 1) WHERE i < length(s)))
SELECT doc_id, idx, seq FROM e WHERE i = length(s)"""


# codons


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).where(F.length("seq") >= 3)
    s = F.col("seq")
    return rows.select("doc_id", codons.translate(s).alias("f1"), codons.translate(s, 2, 3, trim=True).alias("f3"), codons.translate(s, 11, -2, clean=True).alias("r2"), codons.translate(s, 11, 1, mark_start=True).alias("marked"))


# The public genetic codes once more, by codon: the tables in which it differs from the standard code, in which
# it is a start, and the tables whose stops are not those translated to '*'.
_STANDARD = """SELECT a || b || c AS codon, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (strpos('TCAG', a) - 1) + 4 * (strpos('TCAG', b) - 1) + strpos('TCAG', c), 1) AS aa
 FROM (SELECT unnest(string_split('TCAG', '')) AS a), (SELECT unnest(string_split('TCAG', '')) AS b), (SELECT unnest(string_split('TCAG', '')) AS c)"""
CODON_TABLES = f"""SELECT id::INT AS table_id, codon, aa, start AS is_start, CASE id WHEN 27 THEN codon = 'TGA' WHEN 28 THEN codon IN ('TAA', 'TAG', 'TGA') WHEN 31 THEN codon IN ('TAA', 'TAG') ELSE aa = '*' END AS is_stop FROM (
 SELECT id, codon, CASE codon
  WHEN 'TGA' THEN CASE WHEN id IN (2, 3, 4, 5, 9, 13, 14, 21, 24, 27, 28, 31) THEN 'W' WHEN id = 10 THEN 'C' WHEN id = 25 THEN 'G' ELSE aa END
  WHEN 'TAA' THEN CASE WHEN id IN (6, 27, 28) THEN 'Q' WHEN id IN (14, 29) THEN 'Y' WHEN id IN (30, 31) THEN 'E' ELSE aa END
  WHEN 'TAG' THEN CASE WHEN id IN (6, 27, 28) THEN 'Q' WHEN id = 29 THEN 'Y' WHEN id IN (30, 31) THEN 'E' WHEN id IN (16, 22) THEN 'L' ELSE aa END
  WHEN 'ATA' THEN CASE WHEN id IN (2, 3, 5, 13, 21) THEN 'M' ELSE aa END WHEN 'AAA' THEN CASE WHEN id IN (9, 14, 21) THEN 'N' ELSE aa END
  WHEN 'AGA' THEN CASE WHEN id = 2 THEN '*' WHEN id IN (5, 9, 14, 21, 24) THEN 'S' WHEN id = 13 THEN 'G' ELSE aa END
  WHEN 'AGG' THEN CASE WHEN id = 2 THEN '*' WHEN id IN (5, 9, 14, 21) THEN 'S' WHEN id = 13 THEN 'G' WHEN id = 24 THEN 'K' ELSE aa END
  WHEN 'CTT' THEN CASE WHEN id = 3 THEN 'T' ELSE aa END WHEN 'CTC' THEN CASE WHEN id = 3 THEN 'T' ELSE aa END WHEN 'CTA' THEN CASE WHEN id = 3 THEN 'T' ELSE aa END
  WHEN 'CTG' THEN CASE WHEN id = 3 THEN 'T' WHEN id = 12 THEN 'S' WHEN id = 26 THEN 'A' ELSE aa END
  WHEN 'TCA' THEN CASE WHEN id = 22 THEN '*' ELSE aa END WHEN 'TTA' THEN CASE WHEN id = 23 THEN '*' ELSE aa END ELSE aa END AS aa,
  CASE codon WHEN 'ATG' THEN true WHEN 'TTG' THEN id IN (1, 4, 5, 11, 13, 24, 25) WHEN 'CTG' THEN id IN (1, 4, 11, 12, 24, 26) WHEN 'ATT' THEN id IN (2, 4, 5, 11, 23) WHEN 'ATC' THEN id IN (2, 4, 5, 11)
   WHEN 'ATA' THEN id IN (2, 3, 4, 5, 11, 13) WHEN 'GTG' THEN id IN (2, 4, 5, 9, 11, 13, 21, 23, 24, 25) WHEN 'TTA' THEN id = 4 ELSE false END AS start
 FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14, 16, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31]) AS id), ({_STANDARD}) WHERE length(codon) = 3)"""


def _translated(name: str, seq: str, number: int, frame: int) -> str:
    return f"""{name} AS (SELECT doc_id, string_agg(aa, '' ORDER BY i) AS aa FROM (SELECT doc_id, i, substr(upper({seq}), i::INT, 3) AS codon FROM (SELECT doc_id, seq, unnest(range({frame}, length(seq) - 1, 3)) AS i FROM d)) JOIN (SELECT * FROM codes WHERE id = {number}) USING (codon) GROUP BY doc_id)"""


def _translations_sql() -> str:
    # A codon may start a frame that opens at the front or behind a stop that did not itself open one.
    marked = f"""steps AS (SELECT doc_id, i, aa, start FROM (SELECT doc_id, i, substr(upper(seq), i::INT, 3) AS codon FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 1, 3)) AS i FROM d)) JOIN (SELECT * FROM codes WHERE id = 11) USING (codon)),
 runs AS (SELECT *, lag(aa, 1, 'x') OVER w AS prev, row_number() OVER w AS k, sum(CASE WHEN aa = '*' THEN 0 ELSE 1 END) OVER w AS block FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 placed AS (SELECT *, CASE WHEN aa = '*' THEN row_number() OVER (PARTITION BY doc_id, block, aa = '*' ORDER BY i) + CASE WHEN block = 0 THEN 1 ELSE 0 END ELSE 0 END AS stops FROM runs),
 opened AS (SELECT *, k = 1 OR lag(stops, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS open FROM placed),
 m AS (SELECT doc_id, string_agg(CASE WHEN open AND start THEN 'M' ELSE aa END, '' ORDER BY i) AS aa FROM opened GROUP BY doc_id)"""
    return f"""WITH codes(id, codon, aa, start) AS (SELECT table_id, codon, aa, is_start FROM ({CODON_TABLES}) WHERE table_id IN (1, 2, 11)), d AS (SELECT doc_id, seq FROM {SEQ} WHERE length(seq) >= 3), {_translated("a", "seq", 1, 1)}, {_translated("b", "seq", 2, 3)}, {_translated("c", REVCOM.format("seq"), 11, 2)}, {marked}
SELECT d.doc_id, a.aa AS f1, coalesce(regexp_extract(b.aa, '^[^X*]*'), '') AS f3, coalesce(replace(c.aa, '*', 'X'), '') AS r2, m.aa AS marked FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""


def codon_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each codon of each table stands in frame 1 of the documents' bases."""
    rows = sequences(spark, sf_dir).where(F.length("seq") >= 3).select(F.upper("seq").alias("seq"))
    used = rows.select(F.explode(sq.slider(F.col("seq"), 3, 3)["seq"]).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    known = spark.createDataFrame(codons.codon_rows(), "table_id int, codon string, aa string, is_start boolean, is_stop boolean")
    return used.join(F.broadcast(known), "codon")  # 24 tables of 64 codons


CODON_USE = f"""WITH u AS (SELECT substr(seq, i::INT, 3) AS codon, count(*) AS n FROM (SELECT upper(seq) AS seq, unnest(range(1, length(seq) - 1, 3)) AS i FROM {SEQ}) GROUP BY 1)
SELECT t.*, n FROM ({CODON_TABLES}) t JOIN u USING (codon)"""


# qualities


def quality_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qual")
    return qualities(spark, sf_dir).select(
        "doc_id", quality.total_quality(q).alias("total"), F.round(quality.mean_quality(q), 6).alias("mean_quality"), quality.convert_quality(q, "Illumina-1.8+", "Sanger", force=True).alias("sanger"), F.array_join(quality.guess_encodings(q), ",").alias("encodings")
    )


QUALITY_STRINGS = f"""WITH q AS (SELECT doc_id, qual FROM {QUAL}), c AS (SELECT doc_id, ascii(u) AS b FROM (SELECT doc_id, unnest(string_split(qual, '')) AS u FROM q) WHERE u <> ''),
 n AS (SELECT doc_id, b, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT doc_id, sum(n * (b - 33))::BIGINT AS total, min(b) AS lo, max(b) AS hi, sum(n) AS len, -10 * log10(sum(n * pow(10, -(b - 33) / 10)) / sum(n)) AS mq, bool_or(b IN (64, 65)) AS low_letters FROM n GROUP BY doc_id),
 r AS (SELECT doc_id, bool_or(b = 66) AS b66 FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, b) AS k FROM n) WHERE k <= 2 GROUP BY doc_id)
SELECT q.doc_id, coalesce(total, 0)::BIGINT AS total, round(coalesce(mq, 0.0), 6) AS mean_quality, regexp_replace(qual, '[J-~]', 'I', 'g') AS sanger,
 CASE WHEN len IS NULL THEN 'Sanger,Solexa,Illumina-1.3+,Illumina-1.5+,Illumina-1.8+' WHEN lo >= 66 AND NOT low_letters AND b66 THEN 'Illumina-1.5+' ELSE array_to_string(list_filter(['Sanger', CASE WHEN lo >= 59 THEN 'Solexa' END, CASE WHEN lo >= 64 THEN 'Illumina-1.3+' END, CASE WHEN lo >= 66 AND NOT low_letters THEN 'Illumina-1.5+' END, 'Illumina-1.8+'], lambda x: x IS NOT NULL), ',') END AS encodings
 FROM q LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)"""


def quality_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform(quality.quality_values(F.col("qual"), "Illumina-1.3+"), lambda x: x.cast("string"))
    return qualities(spark, sf_dir).select("doc_id", F.md5(F.array_join(values, ",")).alias("values_md5"), F.size(values).alias("n"), F.coalesce(F.array_max(quality.quality_values(F.col("qual"))), F.lit(0)).alias("highest"))


QUALITY_VALUES = f"""SELECT doc_id, md5(array_to_string(list_transform(v, lambda b: (b - 64)::VARCHAR), ',')) AS values_md5, len(v)::INT AS n, coalesce(list_max(v) - 33, 0)::INT AS highest
 FROM (SELECT doc_id, list_transform(list_filter(string_split(qual, ''), lambda u: u <> ''), lambda u: ascii(u)) AS v FROM {QUAL})"""


def quality_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of encodings, each of the letters that hold a value up to 40 in the first one."""
    names = F.array(*[F.lit(x) for x in quality.ENCODINGS])
    kept = [F.struct(F.lit(a).alias("a"), F.regexp_replace("qual", f"[^\\x{low:02x}-\\x{offset + 40:02x}]", "").alias("kept")) for a, (low, _, offset, _) in quality.ENCODINGS.items()]
    pairs = qualities(spark, sf_dir).select("doc_id", F.inline(F.array(*kept))).select("doc_id", "a", F.explode(F.array_remove(names, F.col("a"))).alias("b"), "kept")
    return pairs.select("doc_id", "a", "b", quality.convert_quality(F.col("kept"), F.col("a"), F.col("b")).alias("qual"))


def _conversions_sql() -> str:
    out = []
    for a, (low, _, offset, solexa) in quality.ENCODINGS.items():
        for b, (_, _, new, to_solexa) in quality.ENCODINGS.items():
            if a == b:
                continue
            q = f"(CASE WHEN ascii(u) - {offset} = 2 THEN 0 ELSE ascii(u) - {offset} END)" if a == "Illumina-1.5+" else f"(ascii(u) - {offset})"
            if solexa and not to_solexa:
                q = f"trunc(10 * log10(pow(10, {q} / 10) + 1))"
            elif to_solexa and not solexa:
                q = f"(CASE WHEN {q} = 0 THEN -5 ELSE trunc(greatest(-5, 10 * log10(pow(10, {q} / 10) - 1))) END)"
            out.append(f"""SELECT doc_id, '{a}' AS a, '{b}' AS b, array_to_string(list_transform(list_filter(string_split(regexp_replace(qual, '[^\\x{low:02x}-\\x{offset + 40:02x}]', '', 'g'), ''), lambda u: u <> ''), lambda u: chr(({q} + {new})::INT)), '') AS qual FROM {QUAL}""")
    return " UNION ALL ".join(out)


def quality_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")).select("l_quantity", "n", F.round(quality.phred_to_solexa(q), 6).alias("solexa"), F.round(quality.solexa_to_phred(q), 6).alias("phred"))


QUALITY_SCALES = """SELECT l_quantity, count(*) AS n, round(CASE WHEN l_quantity = 0 THEN -5 ELSE greatest(-5, 10 * log10(pow(10, l_quantity / 10) - 1)) END, 6) AS solexa, round(10 * log10(pow(10, l_quantity / 10) + 1), 6) AS phred FROM lineitem GROUP BY l_quantity"""


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.byte_histogram(qualities(spark, sf_dir), "qual", ["lang"])


BYTE_HISTOGRAM = f"SELECT lang, u AS letter, count(*) AS n FROM (SELECT lang, unnest(string_split(qual, '')) AS u FROM {QUAL}) WHERE u <> '' GROUP BY ALL"


# sketches

_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END::BIGINT"


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.kmer_codes_native(sequences(spark, sf_dir).select("doc_id", "seq"), 5).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _kmer_sql(seq: str, k: int) -> str:
    return " + ".join(f"(strpos('ACGT', substr({seq}, (i + {j + 1})::INT, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))


KMER_COUNTS = f"""WITH d AS (SELECT doc_id, upper(seq) AS f, {REVCOM.format('upper(seq)')} AS r, length(seq) AS n FROM {SEQ}), x AS (SELECT *, unnest(range(0, n - 4)) AS k FROM d WHERE n >= 5),
 y AS (SELECT doc_id, (SELECT {_kmer_sql('x.f', 5)} FROM (SELECT k AS i)) AS a, (SELECT {_kmer_sql('x.r', 5)} FROM (SELECT n - 5 - k AS i)) AS b FROM x)
SELECT least(a, b)::BIGINT AS code, count(*) AS n, count(DISTINCT doc_id) AS docs FROM y GROUP BY 1"""


def kmer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "kmers", k=5).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _hash_sql(name: str, k: int) -> str:
    """A common table of canonical ntHashes: doc_id, i, h (UBIGINT), n."""
    rol = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & ((1 << 64) - 1)
    pair = dict(zip("ACGT", "TGCA", strict=True))
    values = ", ".join(f"('{b}', {j}, {rol(sketches.SEEDS[b], k - 1 - j)}::UBIGINT, {rol(sketches.SEEDS[pair[b]], j)}::UBIGINT)" for b in "ACGT" for j in range(k))
    return f"""{name} AS (SELECT doc_id, p - j AS i, least(bit_xor(f), bit_xor(r)) AS h FROM (SELECT doc_id, length(seq) AS n, unnest(range(0, length(seq))) AS p, unnest(string_split(upper(seq), '')) AS b FROM {SEQ} WHERE length(seq) >= {k})
 JOIN (VALUES {values}) v(b, j, f, r) USING (b) WHERE p - j >= 0 AND p - j <= n - {k} GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY doc_id, p - j")


def nthash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "nthash", k=5).drop("seq")


def nthash_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.nthash_native(sequences(spark, sf_dir), "doc_id", 5)


NTHASH = f"WITH {_hash_sql('x', 5)} SELECT doc_id, i::INT AS idx, {_SIGNED.format('h')} AS code FROM x"


def scaled_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.scaled_minhash(sequences(spark, sf_dir).select("doc_id", "seq"), 7, 10).drop("seq")


SCALED_MINHASH = f"WITH {_hash_sql('x', 7)} SELECT doc_id, i::INT AS idx, {_SIGNED.format('h')} AS code FROM x WHERE h <= 1844674407370955161::UBIGINT"


def minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "minimizers", k=7, w=5).drop("seq")


MINIMIZERS = f"""WITH {_hash_sql('x', 7)}, w AS (SELECT doc_id, i, min({{'h': h, 'i': i}}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM x)
SELECT DISTINCT doc_id, m.i::INT AS idx, {_SIGNED.format('m.h')} AS code FROM w WHERE n = 5"""


def minimizers_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the table function of SQL."""
    table_functions.register(spark)
    sequences(spark, sf_dir).select("doc_id", "seq").createOrReplaceTempView("__bases")
    return spark.sql("SELECT doc_id, idx, code FROM minimizers(TABLE(SELECT doc_id, seq FROM __bases), 7, w => 5)")


def syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "syncmers", k=6, s=3).drop("seq")


SYNCMERS = f"""WITH {_hash_sql('x', 6)}, {_hash_sql('y', 3)}, w AS (SELECT doc_id, i, min({{'h': h, 'i': i}}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM y),
 s AS (SELECT DISTINCT doc_id, CASE WHEN m.i < i + 3 THEN m.i ELSE m.i - 3 END AS i FROM w WHERE n = 6)
SELECT doc_id, i::INT AS idx, {_SIGNED.format('h')} AS code FROM s JOIN x USING (doc_id, i) JOIN (SELECT doc_id FROM {SEQ} WHERE length(seq) >= 8) USING (doc_id)"""


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "simhash", k=21, m=5, scale=5).drop("seq")


def _simhash_sql() -> str:
    """Of the 17 5-mers of each 21-mer those among the lowest fifth are counted, bit by bit."""
    bits = ", ".join(f"sum(CASE WHEN ok THEN (h >> {b}) & 1 ELSE 0 END) OVER w AS b{b}" for b in range(64))
    code = " + ".join(f"CASE WHEN b{b} >= (n + 1) // 2 THEN {1 << b}::HUGEINT ELSE 0::HUGEINT END" for b in range(64))
    return f"""WITH {_hash_sql('x', 5)}, o AS (SELECT *, h <> 0 AND h <= {(1 << 64) // 5}::UBIGINT AS ok FROM x),
 c AS (SELECT doc_id, i, count(*) OVER w AS whole, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n, {bits} FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING)),
 d AS (SELECT doc_id, i, CASE WHEN n = 0 THEN 0::HUGEINT ELSE {code} END AS code FROM c WHERE whole = 17)
SELECT doc_id, i::INT AS idx, {_SIGNED.format('code')} AS code FROM d"""


def protein_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "protein_kmers", k=10).drop("seq")


def protein_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(sequences(spark, sf_dir).select("doc_id", "seq"), "protein_minimizers", k=10, w=5).drop("seq")


def _protein_hash_sql() -> str:
    """Common tables up to x: doc_id, i, h, n, the xxHash64 (seed 1) of all runs of 10 letters of the translation in frame 1.

    Of 10 bytes the first eight are one word, and the other two are read one by one; products are taken modulo 2**64.
    """
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    whole = f"{1 << 64}::UHUGEINT"
    times = lambda x, c: f"(({x})::UHUGEINT * {c}::UHUGEINT % {whole})"
    turned = lambda x, n: f"(({x})::UHUGEINT * {1 << n}::UHUGEINT % {whole} + ({x})::UHUGEINT // {1 << (64 - n)}::UHUGEINT)"
    both = lambda x, y: f"xor(({x})::UBIGINT, ({y})::UBIGINT)"
    byte = lambda j: f"ascii(substr(p, (i + {j + 1})::INT, 1))::UBIGINT"
    word = " + ".join(f"{byte(j)} * {1 << 8 * j}::UHUGEINT" for j in range(8))
    steps = [
        ("a", times(turned(times(word, p2), 31), p1)),
        ("b", f"({times(turned(both('a', (1 + p5 + 10) % (1 << 64)), 27), p1)} + {p4}::UHUGEINT) % {whole}"),
        ("c", times(turned(both("b", times(byte(8), p5)), 11), p1)),
        ("d", times(turned(both("c", times(byte(9), p5)), 11), p1)),
        ("e", times(both("d", f"({'d'})::UHUGEINT // {1 << 33}::UHUGEINT"), p2)),
        ("f", times(both("e", f"({'e'})::UHUGEINT // {1 << 29}::UHUGEINT"), p3)),
        ("g", both("f", f"({'f'})::UHUGEINT // {1 << 32}::UHUGEINT")),
    ]
    out, last = "", "y"
    for name, expression in steps:
        out += f", s{name} AS (SELECT *, {expression} AS {name} FROM {last})"
        last = f"s{name}"
    return f"""codes(id, codon, aa) AS (SELECT table_id, codon, aa FROM ({CODON_TABLES}) WHERE table_id = 1), d AS (SELECT doc_id, seq FROM {SEQ} WHERE length(seq) >= 30), {_translated("t", "seq", 1, 1)},
 y AS (SELECT t.doc_id, aa AS p, length(seq) AS n, unnest(range(0, length(aa) - 9)) AS i FROM t JOIN d USING (doc_id)){out}, x AS (SELECT doc_id, i, g::UBIGINT AS h, n FROM {last})"""


PROTEIN_KMERS = f"WITH {_protein_hash_sql()} SELECT doc_id, i::INT AS idx, {_SIGNED.format('h')} AS code FROM x"
PROTEIN_MINIMIZERS = f"""WITH {_protein_hash_sql()}, w AS (SELECT doc_id, min({{'h': h, 'i': i}}) OVER v AS m, count(*) OVER v AS k FROM x WHERE n >= 34 WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT DISTINCT doc_id, m.i::INT AS idx, {_SIGNED.format('m.h')} AS code FROM w WHERE k = 5"""


# taxonomy

_TREE = """nodes AS (SELECT 1::BIGINT AS taxid, 1::BIGINT AS parent, 'no rank' AS rank, '' AS name UNION ALL SELECT r_regionkey + 10, 1, 'region', r_name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'nation', n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 'supplier', s_name FROM supplier),
 merged AS (SELECT s_suppkey + 900000 AS old, s_suppkey + 1000 AS new FROM supplier WHERE s_suppkey % 7 = 0),
 path AS (SELECT taxid, parent, [taxid] AS p FROM nodes UNION ALL SELECT path.taxid, nodes.parent, list_concat([nodes.taxid], path.p) FROM path JOIN nodes ON path.parent = nodes.taxid WHERE nodes.taxid <> 1 AND path.taxid <> 1),
 lineage AS (SELECT taxid, arg_max(p, len(p)) AS p FROM path GROUP BY taxid), ids AS (SELECT taxid FROM nodes UNION ALL SELECT old FROM merged UNION ALL SELECT 777777)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return t.nodes.select("taxid").unionByName(t.merged.select(F.col("old").alias("taxid"))).unionByName(spark.range(1).select(F.lit(777777).cast("long").alias("taxid")))


def tax_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return t.at_or_below(t.with_rank(t.with_name(t.resolved(_ids(spark, sf_dir)))), "Nation")


TAX_RESOLVE = f"""WITH RECURSIVE {_TREE}, r AS (SELECT ids.taxid, coalesce(n.taxid, new, ids.taxid) AS resolved, n.taxid IS NOT NULL OR new IS NOT NULL AS known FROM ids LEFT JOIN nodes n ON n.taxid = ids.taxid LEFT JOIN merged ON old = ids.taxid)
SELECT r.taxid, r.resolved, r.known, coalesce(n.name, '') AS name, coalesce(n.rank, '') AS rank, coalesce(n.rank IN ('nation', 'supplier'), false) AS at_or_below FROM r LEFT JOIN nodes n ON n.taxid = r.resolved"""


def tax_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    rows = t.with_lineage(_ids(spark, sf_dir), names=True)
    return rows.select("taxid", F.array_join(F.transform("lineage", lambda x: x.cast("string")), ";").alias("lineage"), F.array_join("lineage_names", ";").alias("names"))


TAX_LINEAGE = f"""WITH RECURSIVE {_TREE}, r AS (SELECT ids.taxid, coalesce(n.taxid, new) AS t FROM ids LEFT JOIN nodes n ON n.taxid = ids.taxid LEFT JOIN merged ON old = ids.taxid), u AS (SELECT taxid, unnest(p) AS x, unnest(range(len(p))) AS i FROM lineage),
 v AS (SELECT u.taxid, string_agg(u.x::VARCHAR, ';' ORDER BY i) AS lineage, string_agg(n.name, ';' ORDER BY i) AS names FROM u JOIN nodes n ON n.taxid = u.x GROUP BY 1) SELECT r.taxid, v.lineage, v.names FROM r LEFT JOIN v ON v.taxid = r.t"""


def tax_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n)).select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 7 == 0, 900_000).otherwise(1000)).alias("a"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") + 100).when(F.col("s_suppkey") % 11 == 0, 777777).otherwise((F.col("s_suppkey") * 3) % F.col("n") + 1000).cast("long").alias("b"))
    return t.lca(s)


TAX_LCA = f"""WITH RECURSIVE {_TREE}, s AS (SELECT s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 900000 ELSE 1000 END AS a, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 100 WHEN s_suppkey % 11 = 0 THEN 777777 ELSE s_suppkey * 3 % (SELECT count(*) FROM supplier) + 1000 END AS b FROM supplier),
 r AS (SELECT a, b, coalesce(na.taxid, ma.new) AS ra, coalesce(nb.taxid, mb.new) AS rb FROM s LEFT JOIN nodes na ON na.taxid = a LEFT JOIN merged ma ON ma.old = a LEFT JOIN nodes nb ON nb.taxid = b LEFT JOIN merged mb ON mb.old = b)
SELECT r.a, r.b, CASE WHEN r.a = r.b THEN r.a WHEN ra IS NULL OR rb IS NULL THEN 0 ELSE coalesce(list_last(list_filter(la.p, lambda x: list_contains(lb.p, x))), 1) END::BIGINT AS lca FROM r LEFT JOIN lineage la ON la.taxid = ra LEFT JOIN lineage lb ON lb.taxid = rb"""


# features


def gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.parse_gtf(_gtf_lines(spark, sf_dir), chromosomes=["CHR1", "chr2"], features=["EXON"], attributes=["db_xref"])
    return rows.groupBy("seqname", "strand", "frame").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("score").alias("scores"), F.sum(F.size("attributes")).alias("attrs"), F.max(F.element_at("attributes", -1)["value"]).alias("last"))


def _gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a, n = F.col("l_partkey"), F.col("l_linenumber")
    attrs = F.concat(F.lit('gene_id "g'), a, F.lit('"; db_xref "x"; db_xref "'), n, F.lit('"; '))
    first, last = F.when(n % 2 == 0, a + 50).otherwise(a), F.when(n % 2 == 0, a).otherwise(a + 50)
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_suppkey") % 5), F.lit("sim"), F.when(n % 3 == 0, "CDS").otherwise("exon"), first, last, F.when(n % 3 == 1, ".").otherwise(n.cast("string")), F.when(n % 2 == 0, "-").otherwise("+"), F.when(n % 4 == 3, ".").otherwise((n % 3).cast("string")), attrs)
    return li.select(line.alias("value"))


def gtf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the data source, with filters that are pushed down."""
    datasource.register(spark)
    path = shared_path(spark, "gtf")
    _gtf_lines(spark, sf_dir).write.text(path)
    read = spark.read.format("gtf").options(pushdown="true", attributes="db_xref", size=SPLIT).load(path)
    rows = read.where(F.col("seqname").isin("chr1", "chr2") & (F.col("feature") == "exon"))
    return rows.groupBy("seqname", "strand", "frame").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("score").alias("scores"), F.sum(F.size("attributes")).alias("attrs"), F.max(F.element_at("attributes", -1)["value"]).alias("last"))


def fastx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written and read through the data source."""
    datasource.register(spark)
    path = shared_path(spark, "fasta")
    rows = sequences(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(" ["), F.col("lang"), F.lit("] a > b")).alias("name"), "seq")
    rows.write.format("fastx").option("width", 70).mode("append").save(path)
    return spark.read.format("fastx").option("size", SPLIT).load(path).select("id", "desc", "seq", sq.guess_alphabet(F.col("seq")).alias("alphabet"))


GTF = """WITH x AS (SELECT 'chr' || (l_suppkey % 5) AS seqname, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_linenumber % 3 END AS frame, l_partkey AS s, l_linenumber AS n FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_suppkey % 5 IN (1, 2))
SELECT seqname, strand, frame::INT AS frame, count(*) AS n, sum(s)::BIGINT AS starts, sum(s + 50)::BIGINT AS ends, sum(CASE WHEN n % 3 = 1 THEN NULL ELSE n::DOUBLE END) AS scores, (2 * count(*))::BIGINT AS attrs, max(n::VARCHAR) AS last FROM x GROUP BY ALL"""


def _bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 100000
    return o.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 7), start, start + 10 + F.col("o_custkey") % 90, F.col("o_orderpriority"), F.col("o_custkey") % 1000, F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("."), start, start + 5, F.lit("0,0,0"), F.lit(2), F.lit("4,5,"), F.lit("0,5,")).alias("value"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.parse_bed(_bed_lines(spark, sf_dir), 12)
    again = features.parse_bed(features.format_bed(rows, 12), 12)
    return again.groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum("thick_end").alias("thick"), F.sum(F.element_at("block_sizes", 2)).alias("blocks"), F.max("name").alias("name"))


BED = """SELECT 'chr' || (o_custkey % 7) AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' END AS strand, count(*) AS n, sum(10 + o_custkey % 90)::BIGINT AS length, sum(o_orderkey % 100000 + 5)::BIGINT AS thick, (5 * count(*))::BIGINT AS blocks, max(o_orderpriority) AS name FROM orders GROUP BY ALL"""


def bed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.parse_bed(_bed_lines(spark, sf_dir), 4)
    urgent, low = rows.where("name = '1-URGENT'"), rows.where("name = '5-LOW'")
    return features.overlaps(urgent, low, width=256).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.least("chrom_end", "chrom_end_b") - F.greatest("chrom_start", "chrom_start_b")).cast("long").alias("shared"))


BED_OVERLAPS = """WITH x AS (SELECT o_custkey % 7 AS c, o_orderkey % 100000 AS s, o_orderkey % 100000 + 10 + o_custkey % 90 AS e, o_orderpriority AS p FROM orders)
SELECT 'chr' || a.c AS chrom, count(*) AS n, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared FROM x a JOIN x b ON a.c = b.c AND a.s < b.e AND b.s < a.e WHERE a.p = '1-URGENT' AND b.p = '5-LOW' GROUP BY a.c"""


# files


def _fasta(spark: SparkSession, sf_dir: str, width: int = 60) -> tuple[str, DataFrame]:
    path = shared_path(spark, "fasta")
    rows = sequences(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(" ["), F.col("lang"), F.lit("] a > b")).alias("name"), "seq")
    fastx.write_fastx(rows, path, width)
    return path, rows


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastx.read_fasta(spark, _fasta(spark, sf_dir)[0]).select("id", "desc", "seq", "alphabet")


FASTA_ROUND_TRIP = f"SELECT 'doc' || doc_id AS id, '[' || lang || '] a > b' AS \"desc\", seq, CASE WHEN seq = '' THEN 'Unlimit' ELSE 'DNA' END AS alphabet FROM {SEQ}"


_LETTERS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTAC"


def _fastq(spark: SparkSession, sf_dir: str, **options: str) -> str:
    path = shared_path(spark, "fastq")
    rows = qualities(spark, sf_dir).select(F.concat(F.lit("read"), F.col("doc_id")).alias("name"), F.translate("qual", *_LETTERS).alias("seq"), "qual")
    fastx.write_fastx(rows, path, always_fastq=True, **options)
    return path


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastx.read_fastx(spark, _fastq(spark, sf_dir, compression="gzip")).select("id", F.md5("seq").alias("seq_md5"), "qual", "is_fastq")


def fastq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastx.read_fastq(spark, _fastq(spark, sf_dir)).select("id", F.md5("seq").alias("seq_md5"), "qual", "is_fastq")


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of FASTQ records whose sequences and qualities are wrapped at widths of their own; any sign may begin a line."""
    seq, qual = fastx.wrapped(F.translate("qual", *_LETTERS), 60), fastx.wrapped(F.col("qual"), 53)
    return qualities(spark, sf_dir).select(F.concat(F.lit("@read"), F.col("doc_id"), F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value"))


def fastq_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fastq")
    _wrapped(spark, sf_dir).write.text(path)
    return speculative.read_split(spark, path, size=SPLIT).select("id", F.md5("seq").alias("seq_md5"), "qual", "is_fastq")


def fastq_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [r.path for r in blocks.write_blocked(_wrapped(spark, sf_dir), shared_path(spark, "fastq")).collect()]  # a file for each task
    return speculative.read_split(spark, files, size=SPLIT).select("id", F.md5("seq").alias("seq_md5"), "qual", "is_fastq")


_QUOTED = [x.replace("'", "''") for x in _LETTERS]
FASTQ_ROUND_TRIP = f"SELECT 'read' || doc_id AS id, md5(translate(qual, '{_QUOTED[0]}', '{_QUOTED[1]}')) AS seq_md5, qual, true AS is_fastq FROM {QUAL}"
#: Documents of a file of the indexed FASTA files.
FILE = 500


def fasta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fasta")
    rows = sequences(spark, sf_dir).select(F.floor(F.col("doc_id") / FILE).alias("file"), "doc_id", fastx.formatted(F.concat(F.lit("doc"), F.col("doc_id")), F.col("seq"), F.lit(None).cast("string")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id").write.partitionBy("file").text(path)
    index = fai.build_index(spark, path)
    return index.select(F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("long").alias("file"), "name", "length", "start", F.when(F.col("length") > 0, F.col("bases_per_line")).alias("bases_per_line"), F.when(F.col("length") > 0, F.col("bytes_per_line") - F.col("bases_per_line")).alias("line_end"))


FASTA_INDEX = f"""WITH d AS (SELECT doc_id, doc_id // {FILE} AS file, 'doc' || doc_id AS name, length(seq) AS n FROM {SEQ}), e AS (SELECT *, length(name) + 2 AS head, n + greatest(1, (n + 59) // 60) AS body FROM d)
SELECT file::BIGINT AS file, name, n::BIGINT AS length, (sum(head + body) OVER (PARTITION BY file ORDER BY doc_id) - body)::BIGINT AS "start", CASE WHEN n > 0 THEN least(60, n)::INT END AS bases_per_line, CASE WHEN n > 0 THEN 1 END::INT AS line_end FROM e"""


def fasta_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _fasta(spark, sf_dir)
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in RANGES])
    regions = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), F.inline(ranges))
    got = fai.fetch(regions, fai.build_index(spark, path))
    return got.select(F.substring("name", 4, 20).cast("long").alias("doc_id"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("seq").alias("sub"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes (spark, sf_dir)."""
    return {
        "length_stats": length_stats, "nx_lx": nx_lx, "percentiles": percentiles, "percentile_grid": percentile_grid, "quality_values": quality_values, "quality_conversions": quality_conversions, "minimizers_sql": minimizers_sql, "expansions": expansions_of, "base_composition": base_composition, "reverse_complement": reverse_complement, "sub_sequences": sub_sequences, "gaps_and_alphabets": gaps_and_alphabets, "windows": windows,
        "degenerate": degenerate, "translations": translations, "codon_tables": codon_tables, "quality_strings": quality_strings, "quality_scales": quality_scales, "byte_histogram": byte_histogram, "kmer_counts": kmer_counts, "kmer_codes": kmer_codes, "nthash": nthash,
        "nthash_native": nthash_native, "scaled_minhash": scaled_minhash, "minimizers": minimizers, "syncmers": syncmers, "simhash": simhash, "protein_kmers": protein_kmers, "protein_minimizers": protein_minimizers, "tax_resolve": tax_resolve, "tax_lineage": tax_lineage,
        "tax_lca": tax_lca, "gtf": gtf, "gtf_source": gtf_source, "fastx_source": fastx_source, "bed": bed, "bed_overlaps": bed_overlaps, "fasta_round_trip": fasta_round_trip, "fastq_round_trip": fastq_round_trip, "fastq_split": fastq_split, "fastq_wrapped": fastq_wrapped, "fastq_blocked": fastq_blocked, "fasta_index": fasta_index, "fasta_ranges": fasta_ranges,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "length_stats": LENGTH_STATS, "nx_lx": NX_LX, "percentiles": PERCENTILES, "percentile_grid": PERCENTILE_GRID, "quality_values": QUALITY_VALUES, "quality_conversions": _conversions_sql(), "minimizers_sql": MINIMIZERS, "expansions": EXPANSIONS, "base_composition": BASE_COMPOSITION, "reverse_complement": REVERSE_COMPLEMENT, "sub_sequences": _range_sql(""), "gaps_and_alphabets": GAPS_AND_ALPHABETS, "windows": WINDOWS,
        "degenerate": DEGENERATE, "translations": _translations_sql(), "codon_tables": CODON_USE, "quality_strings": QUALITY_STRINGS, "quality_scales": QUALITY_SCALES, "byte_histogram": BYTE_HISTOGRAM, "kmer_counts": KMER_COUNTS, "kmer_codes": KMER_COUNTS, "nthash": NTHASH, "nthash_native": NTHASH,
        "scaled_minhash": SCALED_MINHASH, "minimizers": MINIMIZERS, "syncmers": SYNCMERS, "simhash": _simhash_sql(), "protein_kmers": PROTEIN_KMERS, "protein_minimizers": PROTEIN_MINIMIZERS, "tax_resolve": TAX_RESOLVE, "tax_lineage": TAX_LINEAGE, "tax_lca": TAX_LCA, "gtf": GTF, "gtf_source": GTF, "fastx_source": FASTA_ROUND_TRIP, "bed": BED, "bed_overlaps": BED_OVERLAPS, "fasta_round_trip": FASTA_ROUND_TRIP, "fastq_round_trip": FASTQ_ROUND_TRIP, "fastq_split": FASTQ_ROUND_TRIP, "fastq_wrapped": FASTQ_ROUND_TRIP, "fastq_blocked": FASTQ_ROUND_TRIP, "fasta_index": FASTA_INDEX,
        "fasta_ranges": _range_sql(" AND a0 >= -n"),
    }
