"""The pipeline on a small input, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import jaccard


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "jaccard", "mixing", "sentencepiece"]
    toxic, quality, single, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    clean = toxic(spark, docs, sf).cache()
    assert clean.columns == docs.columns
    marked = labels.where("toxic = 0").join(docs, "doc_id")
    assert clean.join(marked.select("doc_id"), "doc_id").count() >= 0.95 * marked.count()
    assert clean.join(labels.where("toxic = 1"), "doc_id").count() <= 0.3 * labels.where("toxic = 1").count()
    good = quality(spark, clean, sf).cache()
    known = clean.join(labels, "doc_id")
    assert good.columns == docs.columns and good.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * known.where("quality = 1").count()
    one = single(spark, good, sf).cache()
    groups = jaccard.joined(good)
    assert one.columns == docs.columns and one.count() == groups.select("group_id").distinct().count()
    assert one.join(groups.groupBy("group_id").agg(F.min("doc_id").alias("doc_id")), "doc_id").count() == one.count()
    mixed = mix(spark, one, sf).cache()
    assert mixed.columns == docs.columns and mixed.join(one, "doc_id", "left_anti").count() == 0
    out = encode(spark, mixed, sf)
    assert out.count() == mixed.count() and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and a column of an unlucky name."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = lambda k: " ".join(f"{c}{k}" for c in ("plain", "words", "of", "a", "calm", "story", "that", "goes", "on")) + "."
    odd = [(None, None, "en", "s1", 0), (None, "", "en", None, 0), (None, text(1), "en", "s1", 9), (None, text(2), None, "s2", 9), (7, text(3), "en", "s1", 9), (7, text(4), "en", "s1", 9), (7, text(4), "en", "s1", 9), (10**9, "long words " * 30_000, "en", "s2", 9)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("keep", F.lit("k")).withColumn("score", F.lit(0.1)).withColumn("n_tokens", F.lit("x")).withColumn("x.y", F.lit(1)).withColumn("a`b", F.lit(2))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, now, str(tmp_path)))
        assert out.columns == now.columns, name
        if name == "jaccard":
            kept = [r.text for r in out.collect()]
            assert len(kept) == len({t or "" for t in kept})
            for t in {r.text for r in now.collect()} & {text(k) for k in (1, 2, 3, 4)}:
                assert t in kept  # different texts under null and repeated ids
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == now.count() and dict(last.dtypes)["n_tokens"] == "bigint" and dict(last.dtypes)["keep"] == "string"
