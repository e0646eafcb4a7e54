"""Lines of a byte range of a file, plain or in blocked gzip.

Blocked gzip is a run of small gzip members whose headers tell their sizes, so blocks can be found from anywhere in the
file: by the sign that they begin with, a header that is whole, and data that unpack to the size and checksum behind them.
A range owns the blocks that begin inside it.

Lines: but for the first range of a file, a range passes over what comes before its first line end, and each reads on
behind its end up to the first line end there, whatever blocks that takes. So every line has one owner.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Reader, create_file, files, open_file, split_bytes

#: How a gzip member with extra fields begins, and the two letters of the field that holds a block's size.
SIGN, FIELD = b"\x1f\x8b\x08\x04", b"BC"
#: Bytes that are read at a time from plain files.
CHUNK = 1 << 20


def block_size(file: Reader, offset: int) -> tuple[int, int] | None:
    """Bytes of the block's header and of the whole block at an offset; None if there is no header of a block."""
    head = file.read(offset, 12)
    if len(head) < 12 or head[:4] != SIGN:
        return None
    extra = struct.unpack("<H", head[10:12])[0]
    fields, at = file.read(offset + 12, extra), 0
    while at + 4 <= len(fields):
        size = struct.unpack("<H", fields[at + 2 : at + 4])[0]
        if fields[at : at + 2] == FIELD and size == 2 and at + 6 <= len(fields):
            whole = struct.unpack("<H", fields[at + 4 : at + 6])[0] + 1
            return (12 + extra, whole) if whole > 12 + extra + 8 else None
        at += 4 + size
    return None


def block_at(file: Reader, offset: int) -> tuple[bytes, int] | None:
    """What the block at an offset holds, and where it ends; None if there is no valid block."""
    found = block_size(file, offset)
    raw = file.read(offset, found[1]) if found else b""
    if not found or len(raw) < found[1]:
        return None
    try:
        data = zlib.decompress(raw[found[0] : -8], -15)
    except zlib.error:
        return None
    check, size = struct.unpack("<II", raw[-8:])
    return (data, offset + found[1]) if size == len(data) & 0xFFFFFFFF and check == zlib.crc32(data) else None


def block(data: bytes, level: int = 6) -> bytes:
    """One block; of no data, the one that marks a file's end."""
    made = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = made.compress(data) + made.flush()
    return SIGN + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + FIELD + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(data: bytes, level: int = 6, size: int = 0xFF00) -> bytes:
    """Blocked gzip of data."""
    return b"".join(block(data[a : a + size], level) for a in [*range(0, len(data), size), len(data)])


def write_blocked(values: DataFrame, path: str, level: int = 6, size: int = 0xFF00) -> DataFrame:
    """Write the lines of a column value as blocked gzip, a file for each task; path and length of the files.

    Files are named anew by each attempt, so what failed attempts leave behind is in no row: read the files that are listed. The
    list is to be kept (written or collected) before it is used; it is made while the files are.
    """

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, held, length = f"{path}/part-{uuid.uuid4().hex}.gz", None, b"", 0
        for batch in batches:
            out = out or create_file(name)
            held += b"".join(x.encode("utf-8", "replace") + b"\n" for x in batch.column(0).to_pylist() if x is not None)
            whole = len(held) // size * size
            for a in range(0, whole, size):
                length += out.write(block(held[a : a + size], level))
            held = held[whole:]
        if out:
            for part in [held, b""] if held else [b""]:
                length += out.write(block(part, level))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name] if out else [], pa.string()), pa.array([length] if out else [], pa.int64())], names=["path", "length"])

    return values.select("value").mapInArrow(files_of, "path string, length long")


def _plain(file: Reader, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a file from start on, none of which lies on both sides of end: (where it begins, what it holds)."""
    while part := file.read(start, min(CHUNK, end - start) if start < end else CHUNK):
        yield start, part
        start += len(part)


def _blocks(file: Reader, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Blocks from the first one that begins at start or behind it: (where it begins, what it holds)."""
    at = start
    while True:
        at = file.find(SIGN, at, end)
        if at < 0:
            return
        if block_at(file, at):
            break
        at += 1
    while at < file.size:
        found = block_at(file, at)
        if found is None:
            raise ValueError(f"no block at byte {at}")
        yield at, found[0]
        at = found[1]


def _stream(file: Reader, path: str) -> Iterator[tuple[int, bytes]]:
    """A file that can't be split, from its front: by its ending gz, bz2, xz, zst or plain."""

    class Raw(io.RawIOBase):
        at = 0

        def readable(self) -> bool:
            return True

        def readinto(self, out: memoryview) -> int:
            part = file.read(self.at, len(out))
            out[: len(part)] = part
            self.at += len(part)
            return len(part)

    raw = io.BufferedReader(Raw(), CHUNK)
    if path.endswith(".zst"):
        import zstandard

        opened = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    else:
        opened = next((f for end, f in {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.items() if path.endswith(end)), lambda x: x)(raw)
    while part := opened.read(CHUNK):
        yield 0, part


def lines(file: Reader, path: str, kind: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that a range owns, without their line feeds. kind: as layout() gives it."""
    parts = {"plain": lambda: _plain(file, start, end), "blocked": lambda: _blocks(file, start, end)}.get(kind, lambda: _stream(file, path))()
    held, passing = [], start > 0
    for at, data in parts:
        if at >= end:  # behind the range only the first line end counts
            stop = data.find(b"\n")
            if passing or stop >= 0:
                if not passing:
                    yield b"".join([*held, data[:stop]])
                return
            held.append(data)
            continue
        if passing:
            stop = data.find(b"\n")
            if stop < 0:
                continue
            data, passing = data[stop + 1 :], False
        whole = data.split(b"\n")
        if len(whole) > 1:
            yield b"".join([*held, whole[0]])
            yield from whole[1:-1]
            held = [whole[-1]]
        else:
            held.append(whole[0])
    if any(held):
        yield b"".join(held)


def layout(spark: SparkSession, path: str | list[str], size: int | None = None) -> DataFrame:
    """path, kind ('plain', 'blocked', or 'stream': one range), length, start and end of the ranges of the files at a path."""
    size = size or split_bytes(spark)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for p in batch.column(0).to_pylist():
                if not p.endswith((".gz", ".bgz", ".bz2", ".xz", ".zst")):
                    kinds.append("plain")
                    continue
                with open_file(p) as f:
                    kinds.append("blocked" if p.endswith(("gz", "bgz")) and block_size(Reader(f, 1 << 10), 0) else "stream")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string())], names=["path", "length", "kind"])

    found = files(spark, path).where("length > 0").mapInArrow(told, "path string, length long, kind string")
    step = F.when(F.col("kind") == "stream", F.col("length")).otherwise(F.lit(size).cast("long"))
    rows = found.select("path", "kind", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"), step.alias("__step"))
    return rows.select("path", "kind", "length", "start", F.least(F.col("start") + F.col("__step"), F.col("length")).alias("end"))
