"""FASTA, FASTQ and GTF as data sources of Spark: spark.read.format("fastx"), .format("gtf"), df.write.format("fastx").

    register(spark)
    spark.read.format("fastx").option("ids", "chr1,chr2").load("genomes/*.fa")
    spark.read.format("gtf").options(chromosomes="chr1", features="exon,CDS", attributes="gene_id").load("a.gtf.gz")
    spark.read.format("gtf").option("pushdown", "true").load("a.gtf.gz").where("seqname = 'chr1' AND start > 1000")
    df.write.format("fastx").option("width", 80).mode("append").save("out")

Plain and blocked-gzip files of FASTA and GTF are read in ranges, others file by file (FASTQ is split by
speculative.read_split, which takes two passes). What is asked of names acts on a record's header or a line's fields before
anything else is parsed: by options, or with pushdown by the filters of a query, among them those on path, which act before a file
is opened. Take pushdown for frames that serve one query: Spark 4.1 keeps the filters that were pushed down with a loaded frame, and
a later query of the same frame that pushes none would still see them. Only the columns of .schema("id string") are made.

A writing task makes a file in a folder of the job's own, and the files are moved to their places once all tasks are done.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import block_size, lines
from .ranges import Reader, create_file, open_file, uri
from .speculative import HEAD, fasta_in, fastq_in

#: Letters of texts in a batch.
BATCH = 1 << 23
Test = Callable[[object], bool]


def test_of(f: ds.Filter) -> Test | None:
    """What a filter asks of a column's value; None for filters that are left to Spark."""
    kinds: dict[type, Callable[[object], Test]] = {
        ds.EqualTo: lambda v: lambda x: x == v, ds.In: lambda v: lambda x: x in set(v), ds.StringStartsWith: lambda v: lambda x: x.startswith(v), ds.StringEndsWith: lambda v: lambda x: x.endswith(v), ds.StringContains: lambda v: lambda x: v in x,
        ds.GreaterThan: lambda v: lambda x: x > v, ds.GreaterThanOrEqual: lambda v: lambda x: x >= v, ds.LessThan: lambda v: lambda x: x < v, ds.LessThanOrEqual: lambda v: lambda x: x <= v,
    }
    if isinstance(f, ds.IsNotNull):
        return lambda x: x is not None
    made = kinds.get(type(f))
    inner = made(f.value) if made else None
    return inner and (lambda x: x is not None and inner(x))


@dataclass
class Range(ds.InputPartition):
    path: str
    kind: str
    length: int
    start: int
    end: int
    sign: str = ""


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files below a folder, or of those of a folder whose names match a pattern; hidden ones are
    left out."""
    full = uri(path)
    pattern = full.rpartition("/")[2] if re.search(r"[*?\[]", full) else None
    system, inner = fs.FileSystem.from_uri(full.rpartition("/")[0] if pattern else full)
    prefix = full[: len(full) - len(inner)] if not pattern and full.endswith(inner) else re.match(r"([a-z0-9]+://[^/]*)?", full)[0]
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=not pattern))
    hidden = lambda x: any(p[:1] in "_." for p in x.path[len(inner) :].split("/") if p)
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and not hidden(x) and (not pattern or fnmatch.fnmatch(x.base_name, pattern)))


class _Reader(ds.DataSourceReader):
    """Ranges of files, and the filters that are pushed down."""

    #: Columns whose filters the reader takes.
    columns: tuple[str, ...] = ()

    #: Options that list values of a column, and whether their case counts.
    listed: tuple[tuple[str, str, bool], ...] = ()

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options, self.tests = schema, {k.lower(): v for k, v in options.items()}, []
        for option, column, cased in self.listed:
            if self.options.get(option):
                known = {x.strip() if cased else x.strip().lower() for x in self.options[option].split(",")}
                self.tests.append((column, (lambda x, known=known: x in known) if cased else (lambda x, known=known: x.lower() in known)))

    def passes(self, column: str, value: object) -> bool:
        return all(test(value) for c, test in self.tests if c == column)

    def splits(self, path: str, sign: str) -> bool:
        return True

    def partitions(self) -> list[Range]:
        size, out = int(self.options.get("size", 128 << 20)), []
        for path, length in listed(self.options["path"]):
            if not length or not self.passes("path", path):
                continue
            packed, kind, sign = path.endswith((".gz", ".bgz", ".bz2", ".xz", ".zst")), "plain", ""
            with open_file(path) as f:  # its front
                file = Reader(f, 1 << 16)
                if packed:
                    kind = "blocked" if path.endswith(("gz", "bgz")) and block_size(file, 0) else "stream"
                sign = next((x[:1].decode("latin-1") for x in lines(file, path, kind, 0, length) if x.rstrip(b"\r")), "")
            step = size if kind != "stream" and self.splits(path, sign) else length
            out += [Range(path, kind, length, a, min(a + step, length), sign) for a in range(0, length, step)]
        return out

    def batches(self, rows: Iterator[tuple[dict[str, object], int]]) -> Iterator[pa.RecordBatch]:
        """Rows, with the letters that each holds, as batches of the schema's columns."""
        kind, names = to_arrow_schema(self.schema), self.schema.names
        held, size = [], 0
        for row, letters in rows:
            held.append([row.get(c) for c in names])
            size += letters
            if size > BATCH or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)


class _Pushes:
    """Takes the filters of a query that the reader can tell by its columns."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            test, column = test_of(f), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if test and column in self.columns:
                self.tests.append((column, test))
            else:
                yield f


class FastxReader(_Reader):
    columns, listed = ("path", "id", "name"), (("ids", "id", True),)

    def splits(self, path: str, sign: str) -> bool:
        if sign not in (">", "@", ""):
            raise ValueError(f"neither FASTA nor FASTQ: {path}")
        return sign == ">"

    def id_of(self, name: str) -> str:
        found = re.search(self.options.get("idregexp", r"^([^ \t]*)"), name)
        return found.group(1) if found else name

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        wanted = lambda name: self.passes("name", name) and self.passes("id", self.id_of(name))
        with open_file(p.path) as f:
            own = lines(Reader(f), p.path, p.kind, p.start, p.end)
            more = lines(Reader(f), p.path, p.kind, p.end, p.length) if p.end < p.length else iter(())
            found = fasta_in(own, more, wanted) if p.sign == ">" else fastq_in(own, more, (HEAD, 0), wanted)
            yield from self.batches(({"path": p.path, "id": self.id_of(name), "name": name, "desc": name[len(name.split(" ")[0].split("\t")[0]) :].lstrip(" \t") if "idregexp" not in self.options else "", "seq": seq, "qual": qual}, len(seq)) for name, seq, qual in found)


class PushingFastx(_Pushes, FastxReader):
    pass


class FastxWriter(ds.DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        if not {"name", "seq"} <= set(schema.names):
            raise ValueError("records have the columns name and seq, and perhaps qual")
        self.path, self.width, self.overwrite = options["path"].rstrip("/"), int(options.get("width", 60)), overwrite
        self.job = uuid.uuid4().hex

    def text(self, row: Row) -> str:
        qual = row["qual"] if "qual" in row else None
        if qual:
            return f"@{row['name']}\n{row['seq'] or ''}\n+\n{qual}\n"
        seq = row["seq"] or ""
        wrapped = [seq[a : a + self.width] for a in range(0, len(seq), self.width)] if self.width > 0 else [seq]
        return "\n".join([f">{row['name']}", *(wrapped or [""])]) + "\n"

    def write(self, iterator: Iterator[Row]) -> ds.WriterCommitMessage:
        name = f"part-{uuid.uuid4().hex}.fx"
        with create_file(f"{self.path}/_{self.job}/{name}") as out:
            for row in iterator:
                out.write(self.text(row).encode("latin-1", "replace"))
        return Written(name)

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri(self.path))

    def commit(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        system, inner = self._folder()
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(inner)):
                if x.type == fs.FileType.File:
                    system.delete_file(x.path)
        for m in messages:
            if m:
                system.move(f"{inner}/_{self.job}/{m.name}", f"{inner}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        """The job's folder goes, with what failed attempts have left in it."""
        system, inner = self._folder()
        if system.get_file_info(f"{inner}/_{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{inner}/_{self.job}")


@dataclass
class Written(ds.WriterCommitMessage):
    name: str


class FastxSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "path string, id string, name string, desc string, seq string, qual string"

    def reader(self, schema: StructType) -> FastxReader:
        return (PushingFastx if self.options.get("pushdown") == "true" else FastxReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FastxWriter:
        return FastxWriter(schema, self.options, overwrite)


class GtfReader(_Reader):
    columns, listed = ("path", "seqname", "source", "feature", "strand", "start", "end"), (("chromosomes", "seqname", False), ("features", "feature", False))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        with open_file(p.path) as f:
            yield from self.batches(self.rows(lines(Reader(f), p.path, p.kind, p.start, p.end)))

    def rows(self, own: Iterator[bytes]) -> Iterator[tuple[dict[str, object], int]]:
        """As features.parse_gtf: what it leaves out, swaps and refuses."""
        only = {x.strip().lower() for x in self.options["attributes"].split(",")} if self.options.get("attributes") else None
        for raw in own:
            c = raw.decode("utf-8", "replace").removesuffix("\r").split("\t")
            if raw.startswith(b"#") or len(c) != 9:
                continue
            if not (self.passes("seqname", c[0]) and self.passes("source", c[1]) and self.passes("feature", c[2]) and self.passes("strand", c[6])):
                continue
            start, end = int(c[3]), int(c[4])
            if c[6] not in ("+", "-", ".") or c[7] not in (".", "0", "1", "2"):
                raise ValueError(f"bad strand or frame: {c[6]} {c[7]}")
            if start > end and c[6] == "+":
                raise ValueError("start is over end on the + strand")
            if start > end and c[6] == "-":
                start, end = end, start
            if not (self.passes("start", start) and self.passes("end", end)):
                continue
            pairs = []
            if "attributes" in self.schema.names:
                for piece in filter(None, (x.strip(" ") for x in re.split(r";(?: |$)", c[8]))):
                    tag, _, value = piece.partition(" ")
                    if only is None or tag.lower() in only:
                        pairs.append({"tag": tag, "value": re.sub('^"|"$', "", value.lstrip(" "))})
            row = {"seqname": c[0], "source": c[1], "feature": c[2], "start": start, "end": end, "score": None if c[5] == "." else float(c[5]), "strand": c[6], "frame": None if c[7] == "." else int(c[7]), "attributes": pairs}
            yield row, len(raw)


class PushingGtf(_Pushes, GtfReader):
    pass


class GtfSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "gtf"

    def schema(self) -> str:
        return "seqname string, source string, feature string, start int, end int, score double, strand string, frame int, attributes array<struct<tag:string,value:string>>"

    def reader(self, schema: StructType) -> GtfReader:
        return (PushingGtf if self.options.get("pushdown") == "true" else GtfReader)(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark push filters down to those that ask for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastxSource, GtfSource):
        spark.dataSource.register(source)
