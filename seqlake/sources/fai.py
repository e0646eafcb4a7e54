"""FASTA indexes: building, reading, and fetching ranges by byte offset.

An index row is (path, name, length, start, bases_per_line, bytes_per_line). Fetching joins regions with the index and
reads only the bytes of each range through the path's file system. Regions are dealt by file and megabyte, so that those
which lie together are read together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "name string, length long, start long, bases_per_line int, bytes_per_line int"
_PIECE_NAMES = ["path", "block", "nr", "size", "name", "length", "before", "bases", "width", "short"]
_PIECE = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def _id(head: str, id_regexp: str | None) -> str:
    """Up to the first blank, or else the first tab; tabs that are left become blanks."""
    if id_regexp:
        found = re.search(id_regexp, head)
        return (found.group(1) if found else head).replace("\t", " ")
    for sign in " \t":
        if head.find(sign) > 0:
            return head[: head.find(sign)].replace("\t", " ")
    return head


def record_row(piece: bytes, first: bool, id_regexp: str | None = None) -> tuple[str, int, int, int | None, int | None] | None:
    """(name, length, bytes before the sequence, bases per line, bytes per line) of one record; None if there is none.

    piece: what stands between two '\\n>' of a file; the first one still has its '>', perhaps behind blank lines. The widths
    of a record without lines are None. FASTQ and other text is an error, and so are lines that differ in width, but for the
    last one and blank lines behind it.
    """
    skipped = 0
    if first:
        body = piece.lstrip(b"\r\n")
        if not body:
            return None
        if not body.startswith(b">"):
            raise ValueError("FASTQ files can't be indexed" if body.startswith(b"@") else "no FASTA file")
        skipped = len(piece) - len(body) + 1
        piece = body[1:]
    head, end, lines = piece.partition(b"\n")
    name, before = _id(head.rstrip(b"\r").decode("latin-1"), id_regexp), skipped + len(head) + 1
    # The separator has taken the last line's end.
    data = np.frombuffer(lines + b"\n", np.uint8) if end else np.zeros(0, np.uint8)
    stops = np.flatnonzero(data == 10)
    wide = np.diff(stops, prepend=-1)
    bare = wide - 1 - (np.take(data, np.maximum(stops - 1, 0)) == 13) * (wide > 1)
    full = len(bare) - int(np.argmax(bare[::-1] > 0)) if (bare > 0).any() else 0
    if not full:
        return name, 0, before, None, None
    # The last line may be shorter, and at a file's end it may lack its line end.
    even = (bare[: full - 1] == bare[0]).all() and (wide[: full - 1] == wide[0]).all()
    if not even or bare[full - 1] > bare[0]:
        raise ValueError(f"lines of {name!r} differ in width")
    return name, int(bare.sum()), before, int(bare[0]), int(wide[0])


def build_index(spark: SparkSession, path: str | list[str], id_regexp: str | None = None) -> DataFrame:
    """path and index columns of every record of FASTA files. id_regexp '^(.+)$' keeps whole heads.

    Files are split among tasks at '\\n>', whatever their size; a record is at most 2 GiB. What tasks send on is a row of a
    few numbers a record: offsets are running sums of the records' bytes within a split, and of the splits within a file.
    Of equal names in a file the first counts. A record without lines keeps the widths of the one before it.
    """
    pieces = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"), F.col("value").cast("binary").alias("value")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: tuple | None = None
        for batch in batches:
            out = []
            for path_, block, nr, value in zip(*(batch.column(i) for i in range(4)), strict=True):
                if path_.as_py().endswith((".gz", ".bz2", ".xz", ".zst")):
                    raise ValueError("compressed files can't be indexed")
                here = (path_.as_py(), block.as_py())
                raw = value.as_buffer().to_pybytes()
                row = record_row(raw, here != split and not here[1], id_regexp) or (None,) * 5
                out.append((*here, nr.as_py(), len(raw) + 2, *row, raw.count(b"\n", row[2]) == 0 if row[3] else False))
                split = here
            columns = list(zip(*out, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE, strict=True)], names=_PIECE_NAMES)

    made = pieces.mapInArrow(rows, "path string, block long, nr long, size long, name string, length long, before long, bases int, width int, short boolean")
    widths = F.when(F.col("bases").isNotNull(), F.struct("bases", "width"))
    blocks = made.groupBy("path", "block").agg(F.sum("size").alias("size"), F.max_by(widths, F.when(F.col("bases").isNotNull(), F.col("nr"))).alias("last"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    blocks = blocks.select("path", "block", F.sum("size").over(Window.partitionBy("path")).alias("all"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("at"), F.last("last", ignorenulls=True).over(ahead).alias("last"))
    inside = Window.partitionBy("path", "block").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumns({"offset": F.coalesce(F.sum("size").over(inside), F.lit(0)), "kept": F.last(widths, ignorenulls=True).over(inside)}).join(blocks, ["path", "block"])
    width = F.coalesce(widths, "kept", "last", F.struct(F.lit(0).alias("bases"), F.lit(0).alias("width")))
    # A file's only line of its last record, where the file ends without a line end.
    unended = (F.col("short") & (F.col("at") + F.col("offset") + F.col("size") == F.col("all"))).cast("int")
    row = F.struct("length", (F.col("at") + F.col("offset") + F.col("before")).alias("start"), width["bases"].alias("bases_per_line"), (width["width"] - unended).alias("bytes_per_line"))
    named = placed.where(F.col("name").isNotNull()).withColumn("row", row)
    return named.groupBy("path", "name").agg(F.min_by("row", "row.start").alias("row")).select("path", "name", "row.*")


def open_index(spark: SparkSession, path: str, id_regexp: str | None = None) -> DataFrame:
    """The index of one FASTA file: read from path + '.fai' if that is there, else built."""
    try:
        found = read_index(spark, path + ".fai")
    except AnalysisException:  # no such file
        return build_index(spark, path, id_regexp)
    file = spark.read.format("binaryFile").load(path).select("path").first().path
    return found.select(F.lit(file).alias("path"), *found.columns)


def write_index(index: DataFrame, path: str) -> None:
    """Tab-separated, in the order of places in the file; part files follow each other in that order. An index of one file: rows of
    several are an error."""
    if "path" in index.columns and index.select("path").distinct().limit(2).count() > 1:
        raise ValueError("an index is of one file: write one for each path")
    index.select("name", "length", "start", "bases_per_line", "bytes_per_line").orderBy("start").write.csv(path, sep="\t", quote="")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of a .fai file. Other than five columns is an error; of equal names the one that starts last counts."""
    rows = spark.read.csv(path, sep="\t", schema=INDEX, mode="FAILFAST", quote="")
    return rows.groupBy("name").agg(F.max_by(F.struct("length", "start", "bases_per_line", "bytes_per_line"), "start").alias("r")).select("name", "r.*")


def position(place: Column, start: Column, length: Column, bases: Column, width: Column) -> Column:
    """Byte offset of a 0-based place in the sequence; places outside are moved to its ends."""
    p = F.greatest(F.lit(0), F.least(place, length))
    return F.when(bases == 0, start).otherwise(start + F.floor(p / F.nullif(bases, F.lit(0))) * width + p % F.nullif(bases, F.lit(0)))


def sub_location(length: Column, start: Column, end: Column) -> Column:
    """As the range rule of sequences, but a start before the first place is not ok."""
    s0, e0 = F.when(start == 0, 1).otherwise(start), F.when(end == 0, -1).otherwise(end)
    s = F.when(s0 < 0, length + s0 + 1).otherwise(s0)
    e = F.when(e0 > length, length).when(e0 < 0, length + e0 + 1).otherwise(e0)
    ok = (length > 0) & ~((s0 < 0) & (e0 < 0) & (s0 > e0)) & (s0 >= -length) & (s0 <= length) & (s - 1 <= e)
    return F.struct(F.when(ok, s).otherwise(0).cast("long").alias("start"), F.when(ok, e).otherwise(0).cast("long").alias("end"), ok.alias("ok"))


def fetch(regions: DataFrame, index: DataFrame, clean: bool = True) -> DataFrame:
    """Add seq to regions(name, start, end): 1-based closed ranges of the index's sequences.

    A name that is not in the index gives null; an empty record or a range that is not ok gives an empty text. Line ends
    are dropped unless clean is false. A file that is shorter than its index says gives what there is.
    """
    idx = index.select("path", "name", F.col("length").alias("__n"), F.col("start").alias("__s"), F.col("bases_per_line").alias("__b"), F.col("bytes_per_line").alias("__w"))
    rows = regions.join(idx, "name", "left").withColumn("__at", sub_location(F.col("__n"), F.col("start"), F.col("end")))
    at = lambda p: position(p, F.col("__s"), F.col("__n"), F.col("__b"), F.col("__w")).cast("long")
    rows = rows.withColumns({"__from": at(F.col("__at.start") - 1), "__to": at(F.col("__at.end") - 1) + 1, "__ok": F.col("__at.ok") & (F.col("__at.end") >= F.col("__at.start"))})
    kept = [*regions.columns, "path", "__n", "__from", "__to", "__ok"]

    @F.pandas_udf("string")
    def read(path: pd.Series, begin: pd.Series, end: pd.Series, ok: pd.Series) -> pd.Series:
        from pyarrow import fs

        out, opened = [None] * len(path), {}
        try:
            for i in sorted(range(len(path)), key=lambda i: (str(path[i]), begin[i] if ok[i] else 0)):
                if not ok[i]:
                    continue
                if path[i] not in opened:
                    system, inner = fs.FileSystem.from_uri(path[i].replace("file:/", "file:///", 1) if path[i].startswith("file:/") and not path[i].startswith("file://") else path[i])
                    opened[path[i]] = system.open_input_file(inner)
                f = opened[path[i]]
                size = f.size()
                a, b = min(int(begin[i]), size), min(int(end[i]), size)
                out[i] = f.read_at(b - a, a).decode("latin-1")
        finally:
            for f in opened.values():
                f.close()
        return pd.Series(out)

    # Regions of names that are not there have no path: they are dealt by name.
    dealt = rows.select(*kept).repartition(F.coalesce("path", "name"), F.floor(F.col("__from") / F.lit(1 << 20)))
    got = dealt.withColumn("seq", read("path", F.coalesce("__from", F.lit(0)), F.coalesce("__to", F.lit(0)), F.coalesce("__ok", F.lit(False))))
    seq = F.when(F.col("__n").isNull(), F.lit(None)).otherwise(F.coalesce("seq", F.lit("")))
    seq = F.translate(seq, "\r\n", "") if clean else seq
    return got.withColumn("seq", seq).drop("path", "__n", "__from", "__to", "__ok")


def base_at(regions: DataFrame, index: DataFrame) -> DataFrame:
    """Add base to regions(name, pos): one letter; null outside the sequence."""
    one = fetch(regions.withColumns({"start": F.col("pos"), "end": F.col("pos")}), index)
    return one.withColumn("base", F.nullif("seq", F.lit(""))).drop("start", "end", "seq")
