"""FASTA and FASTQ files as DataFrames, and back.

FASTA is read through the text source with a record separator, so large files are split among tasks and everything is
an expression. read_fastx reads FASTQ of any form: records that are wrapped can't be found from the middle of a file, so a file
is one task's work, streamed line by line from its file system. read_fastq splits files of four lines a record among tasks.
Compressed files are read by their endings.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import guess_alphabet, is_valid

#: Lines that a task works on at a time.
LINES = 1000
SCHEMA = "path string, rec_no long, id string, name string, desc string, seq string, qual string"


def head_id(name: Column, id_regexp: str | None = None) -> Column:
    """The id of a header: up to the first blank or tab, or a pattern's first group (the whole header where it fails)."""
    if id_regexp is None:
        return F.regexp_extract(name, r"^([^ \t]*)", 1)
    if "(" not in id_regexp:
        raise ValueError("the pattern must have a group")
    return F.when(F.rlike(name, F.lit(id_regexp)), F.regexp_extract(name, id_regexp, 1)).otherwise(name)


def head_desc(name: Column, id_regexp: str | None = None) -> Column:
    return F.regexp_extract(name, r"^[^ \t]*[ \t]+(.*)$", 1) if id_regexp is None else F.lit("")


def fasta_records(values: DataFrame, id_regexp: str | None = None) -> DataFrame:
    """Records of pieces between '\\n>' (column value): id, name, desc, seq, qual (null)."""
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^\n*>?", "")
    parts = F.split(body, "\n", 2)
    # What begins like a FASTQ record, with a line of '+' behind its sequence, is none of FASTA.
    fastq = F.startswith(body, F.lit("@")) & F.rlike(body, F.lit(r"^@[^\n]*\n(?:[^\n+][^\n]*\n)*+\+"))
    name = F.when(fastq, F.raise_error(F.lit("this is a FASTQ file: use read_fastx")).cast("string")).otherwise(parts[0])
    seq = F.coalesce(F.replace(F.get(parts, F.lit(1)), F.lit("\n"), F.lit("")), F.lit(""))
    rows = values.where(F.rlike("value", F.lit("[^\r\n]")))
    return rows.select(*[c for c in values.columns if c != "value"], head_id(name, id_regexp).alias("id"), name.alias("name"), head_desc(name, id_regexp).alias("desc"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_fasta(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, alphabet: str | None = None, validate: bool = False) -> DataFrame:
    """path, id, name, desc, seq, qual (null), alphabet and is_fastq of every record.

    A '>' inside a line is data; headers may stand alone (empty seq); sequences may be wrapped, with any line ends. A FASTQ file
    is an error; read_fastx also tells other files that are no FASTA. The alphabet is guessed for every record unless given.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.input_file_name().alias("path"), "value")
    rows = fasta_records(raw, id_regexp)
    return _finished(rows, alphabet, validate, False)


def _finished(rows: DataFrame, alphabet: str | None, validate: bool, is_fastq: bool | Column) -> DataFrame:
    out = rows.withColumn("alphabet", F.lit(alphabet) if alphabet else guess_alphabet(F.col("seq")))
    out = out.withColumn("is_fastq", F.lit(is_fastq) if isinstance(is_fastq, bool) else is_fastq)
    if validate and alphabet:
        bad = F.raise_error(F.concat(F.lit("invalid letter in "), F.col("name"))).cast("string")
        out = out.withColumn("seq", F.when(is_valid(F.col("seq"), alphabet), F.col("seq")).otherwise(bad))
    return out


def checked(records: DataFrame, alphabet: str | None = None) -> DataFrame:
    """Records (name, seq, perhaps qual) made in code: a quality of another length than its sequence, or a letter that is not of
    the alphabet, is an error."""
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.col("name"))).cast("string")
    seq = F.col("seq")
    if "qual" in records.columns:
        seq = F.when(F.col("qual").isNotNull() & (F.length("qual") != F.length("seq")), bad("sequence and quality differ in length: ")).otherwise(seq)
    if alphabet:
        seq = F.when(is_valid(F.col("seq"), alphabet) | F.col("seq").isNull(), seq).otherwise(bad("invalid letter in "))
    return records.withColumn("seq", seq)


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """(name, seq, qual) of FASTA or FASTQ lines, as told by the first sign; other text is an error.

    FASTQ: sequence and quality may be wrapped; a quality ends where it is as long as its sequence, whatever its lines
    begin with. A quality that is longer, or ends too early, is an error.
    """
    kind, name, seq, qual, in_qual = "", None, [], [], False
    length = have = 0

    def record() -> tuple[str, str, str | None]:
        if kind == "@" and have != length:
            raise ValueError(f"sequence and quality of {name!r} differ in length")
        return name, "".join(seq), "".join(qual) if kind == "@" else None

    for line in lines:
        line = line.rstrip("\r\n")
        if not kind:
            if not line:
                continue
            kind = line[0]
            if kind not in ">@":
                raise ValueError("neither FASTA nor FASTQ")
        if kind == ">":
            if line.startswith(">"):
                if name is not None:
                    yield record()
                name, seq = line[1:], []
            else:
                seq.append(line)
        elif in_qual and have < length:
            qual.append(line)
            have += len(line)
            if have > length:
                raise ValueError(f"quality of {name!r} is longer than its sequence")
        elif line.startswith("@") and (name is None or in_qual):
            if name is not None:
                yield record()
            name, seq, qual, in_qual, length, have = line[1:], [], [], False, 0, 0
        elif line.startswith("+") and not in_qual:
            in_qual, length = True, sum(map(len, seq))
        elif line and in_qual:
            raise ValueError(f"quality of {name!r} is longer than its sequence")
        elif line:
            seq.append(line)
    if name is not None:
        yield record()


def _lines(raw: BinaryIO, path: str) -> Iterator[str]:
    """Lines of a file, decompressed by its ending."""
    ends = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
    made = next((f for end, f in ends.items() if path.endswith(end)), None)
    if path.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    else:
        raw = made(raw) if made else raw
    return io.TextIOWrapper(raw, "latin-1", newline="\n")


def _stream(path: str) -> BinaryIO:
    from pyarrow import fs

    local = path.startswith("file:/") and not path.startswith("file://")
    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if local else path)
    return system.open_input_stream(inner, compression=None, buffer_size=1 << 20)


def parse_binary(df: DataFrame, content: str = "content", path: str = "path", chunk: int = 5000) -> DataFrame:
    """path, rec_no, name, seq, qual of the FASTA or FASTQ files that a binary column holds; decompressed by the path's ending."""
    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(_parser(chunk), _RAW)


def _parser(chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Records of files, chunk rows or 16 MB at a time; files without a content are streamed from their file system."""
    names = ["path", "rec_no", "name", "seq", "qual"]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents = pdf.content if "content" in pdf else [None] * len(pdf)
            for path, content in zip(pdf.path, contents, strict=True):
                with _stream(path) if content is None else io.BytesIO(content) as raw:
                    rows, held = [], 0
                    for number, (name, seq, qual) in enumerate(parse_records(_lines(raw, path))):
                        rows.append((path, number, name, seq, qual))
                        held += len(seq)
                        if len(rows) >= chunk or held > 1 << 24:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=names)

    return parsed


#: Schemes that Python tasks can open; files elsewhere come through Spark's reader of whole files.
STREAMED = ("file", "hdfs", "s3", "gs")
_RAW = "path string, rec_no long, name string, seq string, qual string"


def read_fastx(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, alphabet: str | None = None, validate: bool = False, chunk: int = 5000) -> DataFrame:
    """As read_fasta, for FASTA or FASTQ of any form (gz, bz2, xz, zst), with rec_no (from 0 in each file). One task streams a file.

    An empty file, or one of empty lines, has no records.
    """
    files = spark.read.format("binaryFile").load(path)
    scheme = (path if isinstance(path, str) else next(iter(path), "")).partition(":/")
    streamed = not scheme[1] or scheme[0] in STREAMED
    # Only names are listed here; every file is then a task of its own.
    files = files.select("path").repartition(F.xxhash64("path")) if streamed else files.select("path", "content")
    rows = files.mapInPandas(_parser(chunk), _RAW)
    rows = rows.select("path", "rec_no", head_id(F.col("name"), id_regexp).alias("id"), "name", head_desc(F.col("name"), id_regexp).alias("desc"), "seq", "qual")
    return _finished(rows, alphabet, validate, F.col("qual").isNotNull())


def _records_of_lines(lines: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Names, sequences and qualities of lines, four to a record."""
    if len(lines) % 4:
        raise ValueError("a record is cut off, or its sequence is wrapped: use read_fastx")
    for head, seq, plus, qual in zip(lines[0::4], lines[1::4], lines[2::4], lines[3::4], strict=True):
        if not head.startswith("@") or not plus.startswith("+"):
            raise ValueError("no FASTQ record of four lines: use read_fastx")
        if len(seq) != len(qual):
            raise ValueError(f"sequence and quality of {head[1:]!r} differ in length")
    return [x[1:] for x in lines[0::4]], lines[1::4], lines[3::4]


def read_fastq(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, alphabet: str | None = None, validate: bool = False) -> DataFrame:
    """As read_fasta, for FASTQ files of four lines a record, which are split among tasks at any line, whatever their size.

    In a split the first record begins at the first line with '@' two lines before one with '+': no quality does, as no sequence
    begins with '+'. The lines before it, and those of a last record that is cut off, are put together by file: a few for each
    split. Wrapped or other files are an error; so is a blank line but at a file's end.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"), "value")
    kind = "path string, block long, nr long, line string, name string, seq string, qual string"
    names = [x.split()[0] for x in kind.split(", ")]

    def rows(path_: str, block: int, numbered: list[tuple[int, str]], records: list[str]) -> pa.RecordBatch:
        """Left lines, each in a row, and records."""
        n, (a, b, c) = len(numbered), _records_of_lines(records)
        m = len(a)
        columns = [[path_] * (n + m), [block] * (n + m), [x for x, _ in numbered] + [0] * m, [x for _, x in numbered] + [None] * m, [None] * n + a, [None] * n + b, [None] * n + c]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if name in ("block", "nr") else pa.string()) for x, name in zip(columns, names, strict=True)], names=names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, begun = None, [], False
        for batch in (whole.slice(at, LINES) for whole in batches for at in range(0, whole.num_rows, LINES)):
            paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines = list(zip(batch.column(2).to_pylist(), [x.rstrip("\r") for x in batch.column(3).to_pylist()], strict=True))
            bounds = [0, *(i for i in range(1, len(lines)) if (paths[i], blocks[i]) != (paths[i - 1], blocks[i - 1])), len(lines)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a and (paths[a], blocks[a]) != here:
                    if here:
                        yield rows(*here, held, [])
                    here, held, begun = (paths[a], blocks[a]), [], blocks[a] == 0
                held += lines[a:b]
                if not begun:
                    first = next((i for i in range(len(held) - 2) if held[i][1].startswith("@") and held[i + 2][1].startswith("+")), None)
                    if first is None:
                        continue
                    yield rows(*here, held[:first], [])
                    held, begun = held[first:], True
                whole = len(held) // 4 * 4
                while whole and not any(x for _, x in held[whole - 4 : whole]):  # blank lines at the end
                    whole -= 4
                yield rows(*here, [], [x for _, x in held[:whole]])
                held = held[whole:]
        if here:
            yield rows(*here, held, [])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = list(pdf.sort_values(["block", "nr"]).line)
        while lines and not lines[-1]:
            lines.pop()
        if len(lines) % 4 == 3 and lines[-1].startswith("+"):
            lines.append("")  # an empty record at the end
        a, b, c = _records_of_lines(lines)
        return pd.DataFrame({"path": pdf.path.iloc[0], "name": a, "seq": b, "qual": c})

    found = raw.mapInArrow(parsed, kind)
    whole = found.where("name IS NOT NULL").select("path", "name", "seq", "qual")
    cut = found.where("line IS NOT NULL").select("path", "block", "nr", "line").groupBy("path").applyInPandas(together, "path string, name string, seq string, qual string")
    both = whole.unionByName(cut)
    both = both.select("path", head_id(F.col("name"), id_regexp).alias("id"), "name", head_desc(F.col("name"), id_regexp).alias("desc"), "seq", "qual")
    return _finished(both, alphabet, validate, True)


def wrapped(seq: Column, width: int) -> Column:
    """The text with a line end after every width letters, but none at its end; below 1: as it is."""
    return seq if width < 1 else F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def formatted(name: Column, seq: Column, qual: Column, width: int = 60, always_fastq: bool = False) -> Column:
    """A record's text without its last line end: FASTQ (never wrapped) if it has a quality, else wrapped FASTA."""
    fastq = F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.coalesce(qual, F.lit("")))
    if always_fastq:
        return fastq
    return F.when(F.length(qual) > 0, fastq).otherwise(F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width)))


def write_fastx(df: DataFrame, path: str, width: int = 60, always_fastq: bool = False, mode: str = "errorifexists", **options: str) -> None:
    """Write records (name, seq, qual) as text files; options such as compression go to the text sink."""
    qual = F.col("qual") if "qual" in df.columns else F.lit(None).cast("string")
    df.select(formatted(F.col("name"), F.col("seq"), qual, width, always_fastq).alias("value")).write.mode(mode).options(**options).text(path)


def last_by_name(records: DataFrame) -> DataFrame:
    """One record of each full name: the last of its file (of the greatest path)."""
    order = Window.partitionBy("name").orderBy(F.col("path").desc(), F.col("rec_no").desc())
    return records.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def file_alphabets(records: DataFrame) -> DataFrame:
    """path and alphabet of every file: that of its first record (records as read_fastx gives them)."""
    return records.groupBy("path").agg(F.min_by("alphabet", "rec_no").alias("alphabet"))
