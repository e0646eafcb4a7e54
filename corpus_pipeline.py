"""A corpus pipeline of the library's text operators: toxic and poor documents go, one document of each group of near
copies stays, sources are mixed to target weights, and what is left is encoded.

Every stage takes all rows of the one before. Null texts count as empty; null and repeated ids take part as any other; rows
that repeat are judged each (and are copies of one another for the third stage); texts are read whole; an empty table stays
empty; columns beside doc_id, text and source are carried along, whatever their names, but for the last stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import jaccard, mixing, pieces, quality, toxicity
from seqlake.llm.common import same_columns, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The classifier learns from the labels of docs; without any, all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name="__toxic").where("__toxic < 0.5").drop("__toxic")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more. The classifier learns from the labels of docs."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, name="__quality").where("__quality >= 0.5").drop("__quality")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id (nulls last; of rows that share it the one of the smallest
    class key)."""
    return jaccard.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources reads them; a null source is one of its own, sources without a word go."""
    return same_columns(mixing.mixed(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its SentencePiece ids, their number, and the digests of ids and decoded text."""
    return pieces.encode_texts(docs)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("jaccard", one_of_each), ("mixing", mix), ("sentencepiece", encode)]
#: The stages' models and sketches can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
