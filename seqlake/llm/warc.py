"""Operator 11: WARC archives of compressed records, written and read in splits.

A record is a gzip member. A reading task takes a range of bytes, looks for the sign that gzip members begin with, and
takes a candidate for one if it decodes to a record's header and then to its end; it owns the records that start inside
its range, whatever range they end in. What looks like a member may lie inside a record (an archive in an archive):
so a first pass only tells how far the records of each range reach, and the second begins each range behind the reach of
the ranges before it. From there on members follow one another, and what a task gives is exact.

Writing tasks give every file a name of its own and a row in a manifest, which is written as a table: files of attempts
that failed are in no row, so each record is read once. Records with equal payloads point to one of them ("revisit").
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.ranges import Reader, create_file, cut, dealt, open_file, split_bytes
from .common import matched, sliced, table, written

#: How a gzip member begins, its flag bits that must be 0, a record's version, and the profile of revisits.
MAGIC, RESERVED, VERSION = b"\x1f\x8b\x08", 0xE0, b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file, after which a task begins another one; bytes of payloads in a batch; bytes a record's header has at most.
FILE_BYTES, BATCH_BYTES, HEADER_BYTES = 1 << 30, 8 << 20, 1 << 20
#: Level of compression, and the date that records get.
LEVEL, DATE = 6, "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
MANIFEST = "path string, length long, records long"
RECORDS = "path string, offset long, next long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, payload_bytes long, headers map<string,string>, payload binary"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, object]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as one gzip member. Control characters in a header's value become blanks; headers of None are left out."""
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', str(v))}".encode("utf-8", "replace") for k, v in headers if v is not None]
    data = b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", b""]) + block + _END
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def http_head(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes


def response(record_id: str, uri: str | None, payload: bytes, payload_digest: str, level: int = LEVEL) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")]
    return member(headers, http_head(len(payload)) + payload, level)


def revisit(record_id: str, uri: str | None, payload_bytes: int, payload_digest: str, refers_to: str, level: int = LEVEL) -> bytes:
    """A record without its payload: its block is the head of the answer alone."""
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")]
    return member(headers, http_head(payload_bytes), level)


# reading


@dataclass
class Record:
    offset: int
    next: int
    headers: dict[str, str]
    block: bytes


def head_of(lines: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; the first of a name counts, and a line that begins with a blank goes on."""
    out: dict[str, str] = {}
    last = None
    for line in lines.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower().decode("utf-8", "replace")
            out.setdefault(last, value.strip().decode("utf-8", "replace"))
    return out


def member_at(file: Reader, offset: int) -> tuple[int, list[tuple[dict[str, str], bytes]]] | None:
    """Where the member that begins at an offset ends, and its records (one, as a rule); None if it is no member of records.

    A candidate is given up at the first thing that fails: flags, header of gzip, the record's version and length, its end,
    the checksum behind it.
    """
    head = file.read(offset, 4)
    if len(head) < 4 or head[3] & RESERVED:
        return None
    unpacked, at, records = zlib.decompressobj(31), offset, []
    data = bytearray()
    need, header = 0, None
    try:
        while True:
            # Until a header has been seen, some bytes are enough to turn a false candidate down.
            raw = file.some(at, 1 << 18 if header or records else 1 << 10)
            if not raw:
                return None
            data += unpacked.decompress(raw)
            at += len(raw) - len(unpacked.unused_data)
            while True:
                if header is None:
                    if not b"WARC/".startswith(bytes(data[:5])):
                        return None
                    end = data.find(_END)
                    if end < 0:
                        if len(data) > HEADER_BYTES:
                            return None
                        break
                    header = head_of(bytes(data[:end]))
                    length = header.get("content-length", "")
                    if not length.isascii() or not length.isdigit() or "warc-type" not in header:
                        return None
                    need = int(length)
                    del data[: end + len(_END)]
                if len(data) < need + len(_END):
                    break
                if data[need : need + len(_END)] != _END:
                    return None
                records.append((header, bytes(data[:need])))
                del data[: need + len(_END)]
                header = None
                if not data:
                    break
            if unpacked.eof:
                return (at, records) if records and header is None and not data else None
    except zlib.error:
        return None


def records_in(file: Reader, start: int, end: int) -> Iterator[Record]:
    """The records of the members that begin from start on and before end. Bytes that belong to none are passed over."""
    at = start
    while at < end:
        at = file.find(MAGIC, at, end)
        if at < 0:
            return
        found = member_at(file, at)
        if found is None:
            at += 1
            continue
        for headers, block in found[1]:
            yield Record(at, found[0], headers, block)
        at = found[0]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """A record's payload, and the bytes that the full one has. Of an HTTP message the body; a revisit has none, but its head
    tells how long it was."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(_END)
    if headers["warc-type"] == "revisit":
        told = head_of(head).get("content-length", "")
        return b"", int(told) if told.isascii() and told.isdigit() else len(body)
    return body, len(body)


def reaches(parts: DataFrame) -> DataFrame:
    """parts (path, length, start, end) with where each range really begins: behind the records of all ranges before it."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                with open_file(path) as f:
                    reach = start
                    for record in records_in(Reader(f), start, end):
                        reach = record.next
                    ends.append(reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64())], names=[*batch.schema.names, "reach"])

    found = dealt(parts).mapInArrow(last, "path string, length long, start long, end long, reach long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    return found.withColumn("begin", F.greatest("start", F.coalesce(F.max("reach").over(before), F.lit(0)))).where("begin < end").drop("reach")


def read_records(spark: SparkSession, found: DataFrame, size: int | None = None, payload: bool = True) -> DataFrame:
    """The records of the archives found (path, length: as ranges.files or write_members give them), in ranges of size bytes.

    path, offset, next (places of its member), record_type, record_id, target_uri, refers_to, payload_digest (of the payload that
    is there, else as its header says), content_length, payload_bytes (of the full payload), headers (by lower-case name) and,
    if asked, payload. A payload that is not what its digest says is an error. Empty files have no records.
    """
    parts = written(reaches(cut(found.select("path", "length"), size or split_bytes(spark))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def made(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                held, size_ = [], 0
                with open_file(path) as f:
                    for record in records_in(Reader(f), begin, end):
                        h = record.headers
                        body, full = payload_of(h, record.block)
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:") if h.get("warc-payload-digest", "").startswith("sha1:") else None
                        known = told if h["warc-type"] == "revisit" else digest(body)
                        if told and known != told:
                            raise ValueError(f"the payload at {record.offset} of {path} is not what its digest says")
                        held.append((path, record.offset, record.next, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), known, len(record.block), full, list(h.items()), body if payload and h["warc-type"] != "revisit" else None))
                        size_ += len(body) if payload else 0
                        if size_ > BATCH_BYTES or len(held) >= 10_000:
                            yield made(held)
                            held, size_ = [], 0
                yield made(held)

    return dealt(parts).mapInArrow(rows, RECORDS)


# writing


def write_members(members: DataFrame, path: str, column: str = "member") -> DataFrame:
    """Write records (column: each a gzip member) as archives under path, a few files a task; the manifest (path, length,
    records). Each file begins with a record about itself. A null member writes nothing."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, length, count, done = "", None, 0, 0, []
        try:
            for batch in batches:
                for data in batch.column(0):
                    raw = data.as_py()
                    if raw is None:
                        continue
                    if out is None:
                        name, length, count = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = create_file(name)
                        raw = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n") + raw
                    out.write(raw)
                    length, count = length + len(raw), count + 1
                    if length >= FILE_BYTES:
                        out.close()
                        out = None
                        done.append((name, length, count))
        finally:
            if out is not None:
                out.close()
                done.append((name, length, count))
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["path", "length", "records"])

    return written(members.select(column).mapInArrow(files, MANIFEST))


def archived(pages: DataFrame, path: str, least: int = 0, level: int = LEVEL) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); the manifest of the archives.

    Of the rows with equal payloads of at least least bytes the one of the smallest id (null last, of equal ids the first
    read) is a response, the others are revisits of it; rows with smaller payloads are all responses. Null html is an empty
    payload. Record ids hold the page's id and a number of the row, so rows that repeat are records each. A null url has no
    header. Payloads are equal if SHA-1, CRC-32 and length are.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 3):
                rows = []
                for nr, page, url, html in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = (html or "").encode("utf-8", "replace")
                    sha = digest(payload)
                    rows.append((nr, page, url, sha, zlib.crc32(payload), len(payload), response(f"<urn:page:{page if page is not None else 'null'}:{nr}>", url, payload, sha, level)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["nr", "page", "url", "sha", "crc", "bytes", "member"])

    # Payloads are packed before anything is shuffled, and once.
    rows = pages.select(F.monotonically_increasing_id().alias("nr"), F.col("page_id").cast("long").alias("page"), "url", "html")
    packed = written(rows.mapInArrow(made, "nr long, page long, url string, sha string, crc long, bytes long, member binary").withColumn("key", F.concat_ws(" ", "sha", "crc", "bytes")))
    first = F.min_by(F.struct("page", "nr"), F.struct(F.col("page").isNull(), "page", "nr")).alias("first")
    firsts = packed.where(F.col("bytes") >= least).groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1")
    # Of unique payloads, nothing is moved.
    refers = F.when(F.col("first.nr") != F.col("nr"), F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page").cast("string"), F.lit("null")), F.lit(":"), F.col("first.nr"), F.lit(">")))
    linked = matched(packed, written(firsts), "key", "n", "nr").withColumn("refers", refers)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nr, page, url, sha, size, data, to in zip(*(batch.column(i) for i in range(7)), strict=True):
                if to.is_valid:
                    out.append(revisit(f"<urn:page:{page.as_py() if page.is_valid else 'null'}:{nr}>", url.as_py(), size.as_py(), sha.as_py(), to.as_py(), level))
                else:
                    out.append(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return write_members(linked.select("nr", "page", "url", "sha", "bytes", "member", "refers").mapInArrow(decided, "member binary"), path)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records that archived() wrote."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+):', 1) AS BIGINT)")
    rows = records.where(F.col("record_type").isin("response", "revisit"))
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_path(spark, "warc"))
    return pages_of(read_records(spark, found, payload=False))
