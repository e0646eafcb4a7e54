"""Operator 8: language identification of web pages by Bayesian evidence fusion.

Evidence on a page's language: its text (naive Bayes on hashed byte trigrams), the language its markup declares, the
last label of its address, the language code in its path, and what its host's other pages are written in. How often a
declaration or a suffix goes with a language is counted over all pages, with each page weighted by what its text says.
A host's prior is smoothed towards its domain's, that towards its suffix's, that towards all pages' (the page itself is
left out). A page whose address names no host has the prior of all pages. The posterior is the normalised product.

Markup is read from left to right once, however broken it is: what closes nothing or is never closed costs no second look.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matched, table, written
from .words import chunks

#: Rows of the trigram table, and languages whose counts a task holds at a time. All documents with a language are counted.
BUCKETS, HELD = 1 << 16, 32
#: A text speaks for as many trigrams as it has, but for no more than this.
MOST_TRIGRAMS = 60
#: Pages that the level above counts for in a host's, domain's or suffix's prior, and in the tables of declarations.
SMOOTH = 8.0

#: Languages whose table of logs (4 bytes a bucket) is sent to every task: more are an error.
MOST_LANGUAGES = 1000

_HIDDEN = re.compile(r"<(?:(!--)|(script|style|nav|head)\b)", re.I)
_SHOWN = re.compile(r"<()(article|main)\b", re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "nav", "head", "article", "main")}
_TAG = re.compile(r"<[^>]*>")
#: Numbers of characters that no character has.
_NO_CHARACTER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_HTML, _LANG = re.compile("<html", re.I), re.compile(r"\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I | re.A)


def elements(html: str, opened: re.Pattern, whole_tag: bool) -> Iterator[tuple[int, int, int, int]]:
    """(begin, begin of content, end of content, end) of the outermost elements or comments that opened tells, in one pass.

    One that is never closed is none, and that no closing mark of its kind follows is looked up once. whole_tag: the content
    begins behind the tag's end, else behind its name.
    """
    at, open_for_good = 0, set()
    while m := opened.search(html, at):
        name = (m.group(2) or "").lower()
        at = m.end()
        if name in open_for_good:
            continue
        begin = at
        if whole_tag and name:
            begin = html.find(">", at) + 1
            if not begin:
                return
        if name:
            close = _CLOSED[name].search(html, begin)
            span = close.span() if close else None
        else:
            close = html.find("-->", begin)
            span = (close, close + 3) if close >= 0 else None
        if not span:
            open_for_good.add(name)
            continue
        yield m.start(), begin, *span
        at = span[1]


def without_tags(html: str) -> str:
    """Tags as blanks; what is never closed is text."""
    last = html.rfind(">") + 1
    return _TAG.sub(" ", html[:last]) + html[last:]


def visible(html: str) -> str:
    """What a page shows: its article if it has one, else its body without navigation."""
    parts, at, html = [], 0, html or ""
    for begin, _, _, end in elements(html, _HIDDEN, False):
        parts.append(html[at:begin])
        at = end
    html = " ".join([*parts, html[at:]])
    shown = [html[a:b] for _, a, b, _ in elements(html, _SHOWN, True)]
    return html_.unescape(_NO_CHARACTER.sub("\ufffd", without_tags(" ".join(shown) if shown else html)))


def declared_in(html: str) -> str:
    """The language that the html tag declares, in lower case; empty: none."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(">", m.end())
        found = _LANG.search(html, m.end(), end if end >= 0 else len(html))
        if found:
            return found.group(1).lower()
        if end < 0:
            break
        at = end
    return ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased texts, and where each text's begin."""
    coded = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
    data = np.frombuffer(b"".join(coded) + b"  ", np.uint8).astype(np.uint32)
    value = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    value = ((value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    live = np.ones(len(value), bool)
    live[(begins[1:, None] - np.array([1, 2])).ravel()] = False  # trigrams that reach into the next text
    return value[live].astype(np.int64), begins - 2 * np.arange(len(begins))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, bucket, n) of the batches' texts, summed in the task."""
    counts: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": n[used]})
        counts.clear()

    for pdf in batches:
        texts, langs = list(pdf.text), pdf.lang.to_numpy(object)
        for a, b in chunks(texts, 250_000):
            for lang in dict.fromkeys(langs[a:b]):
                if lang not in counts and len(counts) >= HELD:
                    yield from rows()
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams([t for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang])[0], minlength=BUCKETS)
    yield from rows()


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Log probabilities of the buckets in the language of all rows of pdf (BUCKETS at most)."""
    counts = np.bincount(pdf.bucket, pdf.n, BUCKETS) + 0.1
    return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "logs": [np.log(counts / counts.sum()).astype(np.float32).tobytes()]})


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of the buckets in each, from all labelled documents' whole texts.

    One scan counts; each language's counts meet in a task, and only its row of the table reaches the driver.
    """
    counts = labelled.select("lang", "text").mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = {r.lang: np.frombuffer(r.logs, np.float32) for r in counts.groupBy("lang").applyInPandas(_fitted, "lang string, logs binary").toLocalIterator()}
    names = sorted(rows)
    return names, np.stack([rows[n] for n in names]) if names else np.zeros((0, BUCKETS), np.float32)


def log_likelihoods(table_: np.ndarray, texts: list[str]) -> np.ndarray:
    """One row for each text; texts without a trigram get zeros (no evidence)."""
    out = np.zeros((len(texts), len(table_)))
    value, begins = trigrams(texts)
    n = np.diff(begins)
    full = np.flatnonzero(n)
    if len(full):
        for i, row in enumerate(table_):
            out[full, i] = np.add.reduceat(row[value].astype(np.float64), begins[:-1][full])
        out[full] *= (np.minimum(n, MOST_TRIGRAMS) / np.maximum(n, 1))[full, None]
    return out


def host_of(url: Column) -> Column:
    """The host of an address, without dots at its end; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("."))


def _distribution(logs: Column) -> Column:
    """An array of log weights to probabilities. Arrays of one element: inside them values are not computed again."""
    powers = F.flatten(F.transform(F.array(F.struct(logs.alias("x"), F.array_max(logs).alias("top"))), lambda s: F.transform(s["x"], lambda x: F.exp(x - s["top"]))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    summed = F.transform(F.array(powers), lambda p: F.struct(p.alias("p"), total(p).alias("total")))
    return F.flatten(F.transform(summed, lambda s: F.transform(s["p"], lambda p: p / s["total"])))


def identified(pages: DataFrame, documents: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, declared, suffix, text_lang, lang and probability of every row of pages.

    documents: text and lang, to learn trigrams from. Null pages and declarations are no evidence, nor are addresses that are null
    or name no host (host: empty): such pages do not speak for one another. Ties go to the
    language first in order. Without labelled documents lang is null. Pages that repeat are kept each, and count each as
    evidence; pages are read whole; an empty table gives no rows; other columns of pages do not count.
    """
    spark = pages.sparkSession
    labelled = documents.where(F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    host = host_of(F.col("url"))
    names, logs = fit(labelled)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"documents are in {len(names)} languages, more than {MOST_LANGUAGES}")
    if not names:
        return rows.select("page_id", "url", host.alias("host"), *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    sent = spark.sparkContext.broadcast(logs)

    @F.pandas_udf("text_log array<double>, tag string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = np.array_split(batch.to_numpy(object), max(1, len(batch) // 100))
            yield pd.DataFrame({"text_log": list(np.concatenate([log_likelihoods(sent.value, [visible(x) for x in part]) for part in parts])), "tag": [declared_in(x) for x in batch]})

    tag = F.col("read.tag")
    meta = F.lower(F.regexp_extract("html", r"(?i)http-equiv\s*=\s*[\"']?content-language[\"']?\s+content\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/]*/([a-zA-Z]{2})(?:/|$)", 1))
    seen = rows.withColumn("read", read("html")).select(
        "page_id", "url", host.alias("host"), F.when(tag != "", tag).otherwise(meta).alias("declared"), path.alias("path"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.col("read.text_log").alias("text_log"),
    )
    n = range(len(names))
    seen = seen.withColumn("p", _distribution(F.col("text_log")))
    seen = written(seen)
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in n]
    total = seen.agg(F.count("*").alias("n"), *sums).first()
    overall = [(total[f"s{i}"] + 1) / (total.n + len(names)) if total.n else 1 / len(names) for i in n]

    def conditional(column: str) -> DataFrame:
        """log P(value | language) by value, from pages weighted by their texts."""
        counted = seen.where(F.col(column) != "").groupBy(column).agg(*sums)
        all_ = counted.agg(F.count("*").alias("k"), *[F.sum(f"s{i}").alias(f"s{i}") for i in n]).first()
        return counted.select(F.col(column).alias(f"of_{column}"), F.array(*[F.log((F.col(f"s{i}") + 1) / F.lit(float((all_[f"s{i}"] or 0) + (all_.k or 0) + 1))) for i in n]).alias(f"log_{column}"))

    hosts = written(seen.where("host <> ''").groupBy("host", "domain", "suffix").agg(*sums, F.count("*").alias("n")))
    domains = hosts.groupBy("domain", "suffix").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in n], F.sum("n").alias("dn"))
    suffixes = domains.groupBy("suffix").agg(*[F.sum(f"d{i}").alias(f"t{i}") for i in n], F.sum("dn").alias("tn"))
    levels = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    levels = levels.select(F.col("host").alias("of"), F.col("n").alias("rows"), "n", "dn", "tn", *[F.array(*[F.col(f"{a}{i}") for i in n]).alias(a) for a in "sdt"])
    # Pages without a host have no level to be joined with; each has a key of its own, so that they do not meet in one task.
    keyed = seen.withColumns({"row": F.xxhash64("page_id", "url"), "of": F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("page_id", "text_log").cast("string")))})
    out = matched(keyed, written(levels), "of", "rows", "row")
    for column in ("declared", "path"):
        known = conditional(column)
        out = out.join(F.broadcast(known), out[column] == known[f"of_{column}"], "left")  # codes of two or three letters

    base = F.array(*[F.lit(float(x)) for x in overall])

    def prior(i: Column) -> Column:
        own = F.get("p", i)
        at_suffix = (F.get("t", i) - own + SMOOTH * F.get(base, i)) / (F.col("tn") - 1 + SMOOTH)
        at_domain = (F.get("d", i) - own + SMOOTH * at_suffix) / (F.col("dn") - 1 + SMOOTH)
        of_host = (F.get("s", i) - own + SMOOTH * at_domain) / (F.col("n") - 1 + SMOOTH)
        return F.when(F.col("host") == "", F.get(base, i)).otherwise(of_host)

    evidence = F.transform("text_log", lambda x, i: x + F.log(F.greatest(prior(i), F.lit(1e-9))) + F.coalesce(F.get("log_declared", i), F.lit(0.0)) + F.coalesce(F.get("log_path", i), F.lit(0.0)))
    out = out.withColumn("evidence", evidence).withColumn("posterior", _distribution(F.col("evidence")))
    best = lambda c: F.array(*map(F.lit, names))[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    return out.select("page_id", "url", "host", F.nullif("declared", F.lit("")).alias("declared"), F.nullif("suffix", F.lit("")).alias("suffix"), best("p").alias("text_lang"), best("posterior").alias("lang"), F.array_max("posterior").alias("probability"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
