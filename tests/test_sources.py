"""Files: FASTA, FASTQ, indexes, GTF, BED, and a stream of them."""

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from seqlake.sources import fai, fastx, features
from seqlake.streaming.ingest import running_composition, stream_fasta

FASTA = ">s1 first <one> > x\nACGT\nAC\n\n>empty\n>s2\ttab\nacgu>A\n"
FASTQ = "@r1 a\nACGT\n+\n@III\n@r2\nAC\nGT\n+r2\n+I\nII\n\n@r3\nA\n+\n!\n"


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta(spark, tmp_path, end):
    path = write(tmp_path / "a.fa", FASTA.replace("\n", end))
    want = {("s1", "s1 first <one> > x", "first <one> > x", "ACGTAC"), ("empty", "empty", "", ""), ("s2", "s2\ttab", "tab", "acgu>A")}
    whole = fastx.read_fastx(spark, path)
    assert {(r.id, r.name, r.desc, r.seq) for r in whole.collect()} == want and [r.rec_no for r in whole.orderBy("rec_no").collect()] == [0, 1, 2]
    if end == "\n":
        assert {(r.id, r.name, r.desc, r.seq) for r in fastx.read_fasta(spark, path).collect()} == want
    assert {r.id for r in fastx.read_fastx(spark, path, id_regexp=r"^\w+\s+(\w+)").collect()} == {"first", "empty", "tab"}


def test_fastq_and_compression(spark, tmp_path):
    for name, pack in (("a.fq", bytes), ("b.fq.gz", gzip.compress), ("c.fq.bz2", bz2.compress), ("d.fq.xz", lzma.compress)):
        rows = fastx.read_fastx(spark, write(tmp_path / name, pack(FASTQ.encode()))).orderBy("rec_no").collect()
        assert [(r.id, r.seq, r.qual, r.is_fastq) for r in rows] == [("r1", "ACGT", "@III", True), ("r2", "ACGT", "+III", True), ("r3", "A", "!", True)]
    assert len(list(tmp_path.iterdir())) == 4


def test_fastq_that_is_split(spark, tmp_path):
    """Splits of 300 bytes among records of 10 to 700, with qualities that begin like other lines."""
    records = [(f"r{i} d", "ACGT"[i % 4] * (1 + i * 7 % 340), "@+>I"[i % 4] + "@+!I"[i % 3] * (i * 7 % 340)) for i in range(200)]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    path = write(tmp_path / "a.fq", text + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = fastx.read_fastq(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.name, r.seq, r.qual) for r in rows) == sorted(records)
    assert {(r.id, r.desc, r.is_fastq) for r in rows} == {(n.split()[0], "d", True) for n, _, _ in records}
    two = [write(tmp_path / "b.fq", "@x\r\nAC\r\n+\r\nII\r\n"), write(tmp_path / "c.fq.gz", gzip.compress(b"@y\nA\n+y\n@"))]
    assert sorted((r.name, r.seq, r.qual) for r in fastx.read_fastq(spark, two).collect()) == [("x", "AC", "II"), ("y", "A", "@")]
    for bad, error in (("@r\nAC\n+\nI\n", "differ"), ("@r\nAC\nGT\n+\nII\nII\n", "read_fastx"), (">r\nAC\n", "read_fastx")):
        with pytest.raises(Exception, match=error):
            fastx.read_fastq(spark, write(tmp_path / "bad.fq", bad)).collect()


def test_odd_files(spark, tmp_path):
    assert fastx.read_fastx(spark, write(tmp_path / "empty.fx", "")).count() == 0
    assert fastx.read_fastx(spark, write(tmp_path / "blank.fx", "\n")).count() == 0
    for name, text, error in (("a", " \n", "neither"), ("b", "@r\nACGT\n+\nIIIII\n", "longer"), ("c", "@r\nACGT\n+\nII\n", "differ")):
        with pytest.raises(Exception, match=error):
            fastx.read_fastx(spark, write(tmp_path / name, text)).collect()
    with pytest.raises(Exception, match="invalid letter"):
        fastx.read_fastx(spark, write(tmp_path / "d", ">a\nAC!"), alphabet="DNA", validate=True).collect()
    with pytest.raises(ValueError, match="group"):
        fastx.read_fastx(spark, str(tmp_path / "d"), id_regexp="x")


def test_writing_and_reading_back(spark, tmp_path):
    rows = [("a b", "ACGT" * 40, None), ("q", "ACGT", "!@+>"), ("none", "", None)]
    df = spark.createDataFrame(rows, "name string, seq string, qual string")
    text = {r[0] for r in df.select(fastx.formatted(F.col("name"), F.col("seq"), F.col("qual"), 60)).collect()}
    assert text == {">a b\n" + "ACGT" * 15 + "\n" + "ACGT" * 15 + "\n" + "ACGT" * 10, "@q\nACGT\n+\n!@+>", ">none\n"}
    assert df.select(fastx.wrapped(F.col("seq"), 0)).first()[0] == "ACGT" * 40
    fastx.write_fastx(df.where("qual IS NULL"), f"{tmp_path}/fa", compression="gzip")
    assert {(r.name, r.seq) for r in fastx.read_fasta(spark, f"{tmp_path}/fa").collect()} == {(a, b) for a, b, q in rows if not q}
    doubled = fastx.read_fastx(spark, write(tmp_path / "x.fa", ">a\nA\n>b\nC\n>a\nG\n"))
    assert {(r.name, r.seq) for r in fastx.last_by_name(doubled).collect()} == {("a", "G"), ("b", "C")}


INDEXED = ">s1 x\nACGTA\nACGTA\nAC\n>none\n>s2\nAC\n\n>s3\ty\nACGTACGT"


def index_rows(spark, path, **options):
    return sorted((tuple(r)[1:] for r in fai.build_index(spark, path, **options).collect()), key=lambda r: r[2])


def test_index(spark, tmp_path):
    assert index_rows(spark, write(tmp_path / "a.fa", INDEXED)) == [("s1", 12, 6, 5, 6), ("none", 0, 27, 5, 6), ("s2", 2, 31, 2, 3), ("s3", 8, 41, 8, 8)]
    assert index_rows(spark, write(tmp_path / "b.fa", b">a\r\nACG\r\nT\r\n>b\r\nAC\r\n")) == [("a", 4, 4, 3, 5), ("b", 2, 16, 2, 4)]
    twice = write(tmp_path / "c.fa", b"\n>a x\nA\n>a y\nCC\n")
    assert [r[:3] for r in index_rows(spark, twice)] == [("a", 1, 6)] and [r[0] for r in index_rows(spark, twice, id_regexp="^(.+)$")] == ["a x", "a y"]
    for bad, error in ((b"@a\nA\n+\nI\n", "FASTQ"), (b"ACGT\n", "no FASTA"), (b">a\nAC\nACG\n", "width"), (b">a\nACG\nA\nACG\n", "width"), (b">a\nACG\n\nACG\n", "width")):
        with pytest.raises(Exception, match=error):
            index_rows(spark, write(tmp_path / "bad.fa", bad))
    with pytest.raises(Exception, match="compressed"):
        index_rows(spark, write(tmp_path / "a.fa.gz", gzip.compress(INDEXED.encode())))
    assert index_rows(spark, write(tmp_path / "empty.fa", "")) == []
    index = fai.build_index(spark, f"{tmp_path}/a.fa")
    fai.write_index(index, f"{tmp_path}/a.fai")
    with pytest.raises(ValueError, match="one file"):
        fai.write_index(index.unionByName(index.withColumn("path", F.lit("other"))), f"{tmp_path}/b.fai")
    assert {tuple(r) for r in fai.read_index(spark, f"{tmp_path}/a.fai").collect()} == set(index_rows(spark, f"{tmp_path}/a.fa"))


def test_index_of_a_file_that_is_split(spark, tmp_path):
    """Offsets by reading the bytes at them; splits of 4 kB, records shorter and longer than that."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    records = [(f"r{i}", "ACGTN"[i % 5] * (7 * i % 613 if i % 50 else 9000 + i)) for i in range(400)]
    text = "".join(f">{n} d\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for n, s in records)
    path = write(tmp_path / "long.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = {r[0]: r for r in index_rows(spark, path)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 400
    for name, seq in records:
        _, length, start, bases, width = rows[name]
        assert length == len(seq) and text[: start].endswith(f">{name} d\n")
        assert not seq or (bases, width) == (min(60, len(seq)), min(60, len(seq)) + 1)


def test_an_index_is_used_again(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">x\nACGT\n>y\nGG\n")
    assert {r.name for r in fai.open_index(spark, path).collect()} == {"x", "y"}
    write(tmp_path / "a.fa.fai", "z\t4\t3\t4\t5\n")
    index = fai.open_index(spark, path)
    assert [r.name for r in index.collect()] == ["z"]
    assert fai.fetch(spark.createDataFrame([("z", 2, 3)], "name string, start int, end int"), index).first().seq == "CG"


def test_formats_are_told_apart(spark, tmp_path):
    with pytest.raises(Exception, match="FASTQ"):
        fastx.read_fasta(spark, write(tmp_path / "a.fq", "@r1\nACGT\n+\nIIII\n@r2\nAC\nGT\n+\nII\nII\n")).collect()
    rows = fastx.read_fastx(spark, [write(tmp_path / "b.fx", ">a\nACGU\n>b\n!\n"), write(tmp_path / "c.fx", "@a\nACGT\n+\nIIII\n")])
    assert {(r.path[-4:], r.alphabet) for r in fastx.file_alphabets(rows).collect()} == {("b.fx", "RNA"), ("c.fx", "DNA")}
    held = spark.createDataFrame([("x.gz", gzip.compress(FASTQ.encode())), ("y", FASTA.encode())], "path string, content binary")
    assert sorted((r.path, r.name) for r in fastx.parse_binary(held).collect()) == [("x.gz", "r1 a"), ("x.gz", "r2"), ("x.gz", "r3"), ("y", "empty"), ("y", "s1 first <one> > x"), ("y", "s2\ttab")]


def test_ranges(spark, tmp_path):
    index = fai.build_index(spark, write(tmp_path / "a.fa", ">mir\nUAAACAGUAU\nACAGAAAGCC\nAUCAAAGC\n>blank\n>seq\nACTGACTG\n"))
    whole = "UAAACAGUAUACAGAAAGCCAUCAAAGC"
    want = {("mir", 1, -1): whole, ("mir", 15, 19): whole[14:19], ("mir", -3, -1): "AGC", ("mir", 2, -2): whole[1:-1], ("mir", 20, -2): whole[19:-1], ("mir", 50, -2): "", ("mir", -40, -1): "", ("blank", 1, -1): "", ("seq", 1, -1): "ACTGACTG", ("no", 1, 2): None}
    got = fai.fetch(spark.createDataFrame(list(want), "name string, start int, end int"), index)
    assert {(r.name, r.start, r.end): r.seq for r in got.collect()} == want
    raw = fai.fetch(spark.createDataFrame([("mir", 9, 12)], "name string, start int, end int"), index, clean=False)
    assert raw.first().seq == "AU\nAC"
    bases = fai.base_at(spark.createDataFrame([("mir", 1), ("mir", 99)], "name string, pos int"), index)
    assert {(r.pos, r.base) for r in bases.collect()} == {(1, "U"), (99, None)}


GTF = [
    "# comment", "", "chr1\tx\texon\t10\t20\t.\t+\t0\tgene_id \"g1\"; db_xref \"a\"; db_xref \"b\"; ", "chr2\tx\tCDS\t30\t5\t1.5\t-\t.\tgene_id \"\"; ", "few\tcolumns", "chr1\tx\texon\t1\t2\t.\t.\t2\tgene_id \"g;2\";",
]


def test_gtf(spark):
    lines = spark.createDataFrame([(x,) for x in GTF], "value string")
    rows = {(r.seqname, r.start): r for r in features.parse_gtf(lines).collect()}
    assert set(rows) == {("chr1", 10), ("chr2", 5), ("chr1", 1)}
    assert [tuple(a) for a in rows["chr1", 10].attributes] == [("gene_id", "g1"), ("db_xref", "a"), ("db_xref", "b")]
    r = rows["chr2", 5]
    assert (r.end, r.score, r.strand, r.frame, [tuple(a) for a in r.attributes]) == (30, 1.5, "-", None, [("gene_id", "")])
    assert rows["chr1", 1].strand == "." and rows["chr1", 1].attributes[0].value == "g;2"
    some = features.parse_gtf(lines, chromosomes=["CHR1"], features=["Exon"], attributes=["DB_XREF"]).collect()
    assert sorted(len(r.attributes) for r in some) == [0, 2]
    for bad in ("c\tx\te\tq\t2\t.\t+\t0\t", "c\tx\te\t3\t2\t.\t+\t0\t", "c\tx\te\t1\t2\t.\t*\t0\t", "c\tx\te\t1\t2\t.\t+\t3\t", "c\tx\te\t1\t2\tz\t+\t0\t"):
        with pytest.raises(Exception, match="bad|over"):
            features.parse_gtf(spark.createDataFrame([(bad,)], "value string")).collect()


def test_bed(spark):
    full = "chr1\t10\t30\tn\t5\t.\t12\t20\t0,0,0\t2\t3,4,\t0,9,"
    lines = spark.createDataFrame([(x,) for x in ("# c", "browser position x", 'track name="a b" color=1,2,3', "", full)], "value string")
    r = features.parse_bed(lines, 12).first()
    assert (r.chrom, r.length, r.strand, r.block_sizes, r.block_starts) == ("chr1", 20, None, [3, 4], [0, 9])
    assert features.format_bed(features.parse_bed(lines, 12), 12).first()[0].replace("3,4", "3,4,").replace("0,9", "0,9,") == full
    assert features.parse_bed(lines, 3).columns == ["chrom", "chrom_start", "chrom_end", "length"]
    assert features.track_lines(lines).first().track == {"name": "a b", "color": "1,2,3"}
    for bad, n in (("chr1\t1", 3), ("chr1\tx\t2", 3), ("chr1\t1\t2\tn", 6)):
        with pytest.raises(Exception, match="BED|bad"):
            features.parse_bed(spark.createDataFrame([(bad,)], "value string"), n).collect()
    with pytest.raises(ValueError, match="no BED type"):
        features.parse_bed(lines, 7)


def test_overlaps(spark):
    a = spark.createDataFrame([("c", 0, 100), ("c", 90, 95), ("d", 0, 10)], "chrom string, chrom_start int, chrom_end int")
    b = spark.createDataFrame([("c", 50, 93), ("c", 100, 200), ("d", 9, 40)], "chrom string, chrom_start int, chrom_end int")
    got = sorted((r.chrom, r.chrom_start, r.chrom_start_b) for r in features.overlaps(a, b, width=16).collect())
    assert got == [("c", 0, 50), ("c", 90, 50), ("d", 0, 9)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.fa", ">a\nACGT\n>b\nGG\n")
    query = running_composition(stream_fasta(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("composition").start()
    query.processAllAvailable()
    write(tmp_path / "in/b.fa", ">c\nAAAA\n")
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("composition").first()) == (3, 10, 0.5)


def test_lines_in_slices_of_a_batch(spark, tmp_path, monkeypatch):
    """A task held ten thousand lines, however long, several times over."""
    records = [(f"r{i}", "ACGT" * (i % 5 + 1)) for i in range(700)]
    (tmp_path / "x.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in records))
    got = lambda: sorted((r.name, r.seq) for r in fastx.read_fastq(spark, str(tmp_path / "x.fq")).collect())
    assert fastx.LINES <= 1000 and got() == sorted(records)
    monkeypatch.setattr(fastx, "LINES", 3)
    assert got() == sorted(records)
