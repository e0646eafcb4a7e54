"""Files in splits: every cut of wrapped and blocked files gives what one reader of the whole file gives."""

import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.sources import blocks, fastx, speculative
from seqlake.sources.ranges import Reader


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def own_lines(data, kind, cuts):
    ends = [0, *cuts, len(data)]
    return [list(blocks.lines(Reader(Bytes(data), 5), "x.gz" if kind == "stream" else "x", kind, a, b)) for a, b in zip(ends, ends[1:], strict=False) if b > a]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"bcd", b"\r", b"@x", b"+"]), max_size=9), st.booleans(), st.lists(st.integers(0, 40), max_size=4), st.integers(1, 9))
def test_each_line_has_one_owner(rows, ended, cuts, width):
    data = b"\n".join(rows) + (b"\n" if ended and rows else b"")
    want = data.split(b"\n")
    want = want[:-1] if not want[-1] else want
    got = [x for part in own_lines(data, "plain", sorted(min(c, len(data)) for c in cuts)) for x in part]
    assert got == want
    packed = blocks.packed(data, size=width)
    assert gzip.decompress(packed) == data
    got = [x for part in own_lines(packed, "blocked", sorted(min(c * len(packed) // 40, len(packed)) for c in cuts)) for x in part]
    assert got == want


def wrapped(rng, records, width):
    """FASTQ text of random records, with signs that mislead at the front of lines, wrapped at widths of their own."""
    out = []
    for i in range(records):
        n = rng.choice([0, 1, 3, width, width + 1, 3 * width])
        seq, qual = "".join(rng.choice("ACGTN@") for _ in range(n)), "".join(rng.choice("@+>IIA\"") for _ in range(n))
        seq = "A" + seq[1:] if seq else seq
        cut = lambda s, w: [s[a : a + w] for a in range(0, len(s), w)]
        lines = [f"@r{i} +@>", *cut(seq, rng.choice([width, 2])), "+" + rng.choice(["", "@", f"r{i}"]), *cut(qual, rng.choice([width, 1, 5])), *[""] * rng.choice([0, 0, 1])]
        out += lines
    return "\n".join(out) + rng.choice(["", "\n", "\r\n"])


def read(data, size, kind="plain"):
    """What read_split does, without Spark."""
    parts = [(a, min(a + size, len(data))) for a in range(0, len(data), size)]
    rows = lambda a, b: blocks.lines(Reader(Bytes(data)), "x", kind, a, b)
    state, out = (speculative.HEAD, 0), []
    for a, b in parts:
        out += speculative.fastq_in(rows(a, b), rows(b, len(data)) if b < len(data) else iter(()), state)
        told = speculative.summary(rows(a, b))
        for e in told["ends"]:  # as it comes back from Spark
            assert e["places"] is None or e["places"] == sorted(e["places"])
        state = speculative.follow(state, told)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_wrapped_records_cut_at_every_byte(seed):
    rng = random.Random(seed)
    data = wrapped(rng, 14, rng.choice([3, 4, 7])).encode()
    want = list(fastx.parse_records(iter(data.decode().split("\n"))))
    for cut in range(1, len(data)):
        parts = [read(data, cut)]
        assert parts[0] == want, cut
    packed = blocks.packed(data, size=11)
    for size in range(20, len(packed), 17):
        assert read(packed, size, "blocked") == want


def test_files_in_ranges(spark, tmp_path):
    rng = random.Random(5)
    text = wrapped(rng, 60, 9)
    fasta = "\n\r\n" + "".join(f">s{i} d\n" + "".join(f"{'ACGT' * rng.randint(1, 9)}\r\n" for _ in range(rng.randint(0, 6))) for i in range(40))
    for name, data in {"a.fq": text.encode(), "b.fq.gz": blocks.packed(text.encode(), size=100), "c.fq.gz": gzip.compress(text.encode()), "d.fa": fasta.encode(), "e.fa.bgz": blocks.packed(fasta.encode(), size=70), "f.fa": b"", "g.fq": b"\n\n" * 300}.items():
        (tmp_path / name).write_bytes(data)
        whole = tmp_path / ("d.fa" if name == "e.fa.bgz" else name)
        want = [tuple(r) for r in fastx.read_fastx(spark, str(whole)).select("name", "seq", "qual").collect()]
        for size in (97, 1 << 20):
            rows = speculative.read_split(spark, str(tmp_path / name), size=size)
            assert [tuple(r) for r in rows.orderBy("block", "nr").select("name", "seq", "qual").collect()] == want, (name, size)
    kinds = {r.path.rpartition("/")[2]: (r.kind, r["n"]) for r in blocks.layout(spark, str(tmp_path), 200).groupBy("path", "kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds["b.fq.gz"][0] == "blocked" and kinds["b.fq.gz"][1] > 3 and kinds["c.fq.gz"] == ("stream", 1) and kinds["a.fq"][0] == "plain"
    for bad in ("@a\nAC\n+\nIII\n", "@a\nAC\n+\nI\n", "x\n", "@a\nAC\n+\nI\n@b\nA\n+\nI\n"):
        (tmp_path / "bad.fq").write_text(bad)
        for size in (3, 1000):
            with pytest.raises(Exception, match="differ in length|neither|longer or shorter"):
                speculative.read_split(spark, str(tmp_path / "bad.fq"), size=size).collect()


def test_many_small_ranges_share_tasks(spark):
    """Each range of 256 KB was a task of its own."""
    from seqlake.sources.ranges import dealt

    rows = spark.range(4000).selectExpr("'x' AS path", "id * 1024 AS start", "id * 1024 + 1024 AS `end`")
    assert dealt(rows, 1 << 16).rdd.getNumPartitions() == 4000 * 1024 >> 16
    assert dealt(rows, 1 << 16).count() == 4000 and dealt(rows.limit(3), 1 << 16).rdd.getNumPartitions() == 3
    assert dealt(rows.limit(0), 1 << 16).count() == 0
