"""Archives: round trips, splits at every byte, archives in archives, damage and odd rows."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqlake.llm import warc
from seqlake.sources.ranges import Reader


class Bytes:
    """What Reader needs of a file."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def archive(payloads, level=6):
    members = [warc.response(f"<urn:page:{i}:{i}>", f"http://x/{i}", p, warc.digest(p), level) for i, p in enumerate(payloads)]
    return members, b"".join(members)


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_every_split_owns_the_records_that_start_in_it(block):
    rng = random.Random(1)
    members, data = archive([b"", b"\x1f\x8b\x08", bytes(rng.randrange(256) for _ in range(300)), b"a" * 500, warc.MAGIC * 40])
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    for cut in range(len(data) + 1):
        got = [(r.offset, r.next) for a, b in ((0, cut), (cut, len(data))) for r in warc.records_in(Reader(Bytes(data), block), a, b)]
        assert got == [(s, s + len(m)) for s, m in zip(starts, members, strict=True)]


def test_what_is_no_record_is_passed_over():
    members, data = archive([b"one", b"two" * 100])
    plain = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = plain.compress(b"no record") + plain.flush()
    broken = bytearray(members[1])
    broken[-6] ^= 1  # the checksum
    for noise in (b"", other, b"\x1f\x8b\x08\xff", b"\x1f\x8b", bytes(broken), members[1][:-3]):
        whole = noise + members[0] + noise + members[1]
        got = [r.block for r in warc.records_in(Reader(Bytes(whole)), 0, len(whole))]
        assert [b[-3:] for b in got] == [b"one", b"two"]
    # Two records in one member, a header that goes on in the next line, and a length that is no number.
    text = lambda m: zlib.decompress(m, 31)
    pack = lambda t: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(t) + c.flush()
    both = pack(text(members[0]) + text(members[1]))
    assert [(r.offset, r.next) for r in warc.records_in(Reader(Bytes(both)), 0, len(both))] == [(0, len(both))] * 2
    folded = pack(text(members[0]).replace(b"http://x/0", b"http://x\r\n /0"))
    assert next(warc.records_in(Reader(Bytes(folded)), 0, len(folded))).headers["warc-target-uri"] == "http://x /0"
    bad = pack(text(members[0]).replace(b"Content-Length: 81", b"Content-Length: x"))
    assert not list(warc.records_in(Reader(Bytes(bad)), 0, len(bad)))


def test_an_archive_in_an_archive_is_not_read_twice(spark, tmp_path):
    inner = archive([bytes([i]) * 30 for i in range(200)])[1]
    members, data = archive([b"before", inner, b"behind"], level=0)  # stored as it is
    assert inner in data
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    found = spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long")
    starts = [sum(map(len, members[:i])) for i in range(3)]
    assert len(list(warc.records_in(Reader(Bytes(data)), starts[1] + 100, len(data)))) > 3  # a range alone can't know
    for size in (500, 3000, 1 << 20):
        rows = warc.read_records(spark, found, size=size).orderBy("offset").collect()
        assert [r.offset for r in rows] == starts and [bytes(r.payload) for r in rows] == [b"before", inner, b"behind"]


def test_round_trip_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://a\r\nWARC-Type: x", "x"), (2, None, "x"), (None, "u", "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\U0001f600" * 50_000), (5, "u", "twice"), (5, "u", "twice"), (None, None, "alone"), (-7, "u", "n\r\n\r\nWARC/1.1"), (9, "u", "y"), (8, "u", "y")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, member string").repartition(3)
    found = warc.archived(pages.select("page_id", "url", "html"), f"file://{tmp_path}/w")
    assert found.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_records(spark, found, size=700)
    out = sorted(map(tuple, warc.pages_of(got).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()))
    assert sorted(x[:3] for x in out if x[0] is not None) == sorted(x for x in want if x[0] is not None) and sum(x[0] is None for x in out) == 2
    kinds = sorted((x[0], x[3], x[4]) for x in out if x[0] is not None)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None), (5, "revisit", 5), (-7, "response", None), (8, "response", None), (9, "revisit", 8)])
    assert sorted((x[3], x[4]) for x in out if x[0] is None) == [("response", None), ("revisit", 1)]
    texts = {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert texts == {r[2] or "" for r in rows}
    assert got.where("record_type = 'warcinfo'").count() == found.count()
    # Small payloads are no revisits if that is asked.
    again = warc.pages_of(warc.read_records(spark, warc.archived(pages.select("page_id", "url", "html"), f"file://{tmp_path}/v", least=3)))
    assert {r.page_id for r in again.where("record_type = 'revisit'").collect()} == {5}
    assert not warc.read_records(spark, warc.archived(pages.limit(0), f"file://{tmp_path}/e")).collect()


def test_a_payload_that_is_not_what_its_digest_says(spark, tmp_path):
    data = warc.response("<urn:page:1:1>", None, b"abc", warc.digest(b"abd"))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long")).collect()


def test_one_payload_in_most_rows(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    got = {r.page_id: r.refers_to for r in warc.pages_of(warc.read_records(spark, warc.archived(rows, f"file://{tmp_path}/w"))).collect()}
    assert got == {i: 1 if i % 3 and i > 1 else None for i in range(3000)}
