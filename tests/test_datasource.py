"""The data sources: what they read and write, what is pushed down, and that failed writes leave nothing."""

import contextlib
import io

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlake.sources import blocks, datasource, fastx, features


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def formatted(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_records(source, tmp_path):
    text = "".join(f">s{i} d {i}\n" + "ACGT\n" * (i % 4) for i in range(200))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa.gz").write_bytes(blocks.packed(text.encode(), size=99))
    (tmp_path / "c.fq").write_text("@r1 x\nAC\nG\n+\nI@\nI\n@r2\n\n+\n\n")
    (tmp_path / "_hidden.fa").write_text(">no\nA\n")
    (tmp_path / "empty.fa").write_text("")
    for size in (50, 1 << 20):
        df = source.read.format("fastx").option("size", size).load(str(tmp_path))
        want = fastx.read_fastx(source, [str(tmp_path / x) for x in ("a.fa", "c.fq")]).select("id", "name", "desc", "seq", "qual")
        got = df.where(~F.endswith("path", F.lit(".gz")))
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert df.where(F.endswith("path", F.lit(".gz"))).count() == 200
        parts = df.rdd.getNumPartitions()
        assert parts == 3 if size > 50 else parts > 30
        assert df.count() == 402 and df.where("id = 's7'").count() == 2 and df.count() == 402  # nothing sticks to a frame
    for read in (source.read.format("fastx").option("pushdown", "true"), source.read.format("fastx").option("ids", "s7, s9")):
        one = read.load(str(tmp_path / "*.fa")).where("id = 's7' AND length(seq) > 2")
        assert [(r.name, r.seq) for r in one.collect()] == [("s7 d 7", "ACGT" * 3)]
    pushed = source.read.format("fastx").option("pushdown", "true").load(str(tmp_path / "*.fa")).where("id = 's7' AND length(seq) > 2")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,s7)]" in formatted(pushed)
    assert source.read.format("fastx").schema("id string").load(str(tmp_path / "a.fa")).where("id LIKE 's1%'").count() == 111
    assert [r.id for r in source.read.format("fastx").option("idRegexp", r"(\d+)$").load(str(tmp_path / "a.fa")).limit(2).collect()] == ["0", "1"]
    with pytest.raises(Exception, match="no_such"):
        source.read.format("fastx").load(str(tmp_path / "no_such")).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.fa").write_text("nothing\n")
    with pytest.raises(Exception, match="neither"):
        source.read.format("fastx").load(str(tmp_path / "bad")).collect()


def test_filters_reach_the_reader():
    reader = datasource.PushingFastx(StructType(), {})
    filters = [ds.EqualTo(("id",), "a"), ds.In(("name",), ("a", "b")), ds.GreaterThan(("seq",), "x"), ds.Not(ds.EqualTo(("id",), "b")), ds.StringStartsWith(("path",), "/x"), ds.IsNotNull(("id",))]
    assert list(reader.pushFilters(filters)) == [filters[2], filters[3]]
    assert reader.passes("id", "a") and not reader.passes("id", "b") and not reader.passes("id", None) and reader.passes("name", "b") and not reader.passes("path", "/y")


GTF = ["#c", "chr1\ts\texon\t1\t5\t.\t+\t.\tgene_id \"a; b\"; note x; note \"y\";", "chr2\ts\tCDS\t9\t5\t2.5\t-\t2\tgene_id \"c\"", "short\tline", "chr1\tt\tCDS\t7\t7\t1\t.\t0\t"]


def test_features(source, tmp_path):
    (tmp_path / "a.gtf").write_text("\n".join(GTF * 30) + "\n")
    for size in (40, 1 << 20):
        for attributes in (None, "NOTE,other"):
            read = source.read.format("gtf").option("size", size)
            df = (read.option("attributes", attributes) if attributes else read).load(str(tmp_path / "a.gtf"))
            want = features.parse_gtf(source.createDataFrame([(x,) for x in GTF * 30], "value string"), attributes=attributes.split(",") if attributes else None)
            assert sorted(map(str, df.collect())) == sorted(map(str, want.select(*df.columns).collect()))
    for options in ({"pushdown": "true"}, {"chromosomes": "CHR1", "features": "exon,x"}):
        df = source.read.format("gtf").options(**options).load(str(tmp_path / "a.gtf")).where("seqname = 'chr1' AND feature IN ('exon', 'x') AND start < 7 AND score IS NULL")
        assert df.count() == 30 and df.select("end").distinct().collect()[0].end == 5
    (tmp_path / "bad.gtf").write_text("chr1\ts\texon\t9\t5\t.\t+\t.\tx\n")
    with pytest.raises(Exception, match="start is over end"):
        source.read.format("gtf").load(str(tmp_path / "bad.gtf")).collect()


def test_writing(source, tmp_path):
    out = tmp_path / "out"
    rows = source.createDataFrame([(f"r{i} d", "ACGT" * i, "IIII" * i if i % 2 else None) for i in range(40)], "name string, seq string, qual string")
    fasta = rows.where("qual IS NULL").drop("qual")
    fasta.repartition(3).write.format("fastx").option("width", 10).mode("append").save(str(out))
    assert sorted(r.name for r in source.read.format("fastx").load(str(out)).collect()) == sorted(r.name for r in fasta.collect())
    assert not [x for x in out.iterdir() if x.name.startswith("_")] and max(len(x) for f in out.iterdir() for x in f.read_text().splitlines()) == 10
    bad = fasta.repartition(3).withColumn("seq", F.when(F.col("name") == "r20 d", F.raise_error(F.lit("stop here")).cast("string")).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="stop here"):
        bad.write.format("fastx").mode("append").save(str(out))
    assert source.read.format("fastx").load(str(out)).count() == 20 and not [x for x in out.iterdir() if x.name.startswith("_")]
    rows.where("qual IS NOT NULL").write.format("fastx").mode("overwrite").save(str(out))
    assert sorted((r.name, r.seq, r.qual) for r in source.read.format("fastx").load(str(out)).collect()) == sorted((r.name, r.seq, r.qual) for r in rows.where("qual IS NOT NULL").collect())
    with pytest.raises(Exception, match="name and seq"):
        source.range(3).write.format("fastx").mode("append").save(str(out))
