"""Inputs for the library's queries, derived from the tables at hand: DNA-like and quality-like strings, a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import Taxonomy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the bases of each document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_replace("text", "[^ACGTacgt]", "").alias("seq"))


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and the printable ASCII letters of each document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", "[^!-~]", "").alias("qual"))


def taxonomy(spark: SparkSession, sf_dir: str) -> Taxonomy:
    """Root 1, regions (10 on), nations (100 on), suppliers (1000 on); ids from 900000 on are merged into suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    long = lambda c, n: (F.col(c) + n).cast("long")
    nodes = (
        spark.range(1).select(F.lit(1).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("no rank").alias("rank"))
        .unionByName(region.select(long("r_regionkey", 10).alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("region").alias("rank")))
        .unionByName(nation.select(long("n_nationkey", 100).alias("taxid"), long("n_regionkey", 10).alias("parent"), F.lit("nation").alias("rank")))
        .unionByName(supplier.select(long("s_suppkey", 1000).alias("taxid"), long("s_nationkey", 100).alias("parent"), F.lit("supplier").alias("rank")))
    )
    names = (
        region.select(long("r_regionkey", 10).alias("taxid"), F.col("r_name").alias("name"))
        .unionByName(nation.select(long("n_nationkey", 100).alias("taxid"), F.col("n_name").alias("name")))
        .unionByName(supplier.select(long("s_suppkey", 1000).alias("taxid"), F.col("s_name").alias("name")))
    )
    merged = supplier.where("s_suppkey % 7 = 0").select(long("s_suppkey", 900_000).alias("old"), long("s_suppkey", 1000).alias("new"))
    return Taxonomy(nodes, names, merged)
