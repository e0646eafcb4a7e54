"""Byte ranges of files as rows: how a file that Spark's own readers would not split is dealt to tasks."""

from __future__ import annotations

import re

from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def split_bytes(spark: SparkSession) -> int:
    """spark.sql.files.maxPartitionBytes as a number."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()).groups()
    return int(number) * _UNITS[unit]


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of the files at a path: they are listed, not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def cut(found: DataFrame, size: int) -> DataFrame:
    """path, length, start, end: ranges of about so many bytes of each file (path, length)."""
    rows = found.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return rows.withColumn("end", F.least(F.col("start") + size, F.col("length")))


def dealt(rows: DataFrame, work: int = 0) -> DataFrame:
    """Rows that each stand for a task's work, about one to a partition. With work, ranges (start, end) share partitions of about so
    many bytes once each core has four."""
    if not work:
        return rows.repartition(max(1, rows.count()))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    return rows.repartition(max(1, min(n, max(4 * rows.sparkSession.sparkContext.defaultParallelism, size // work))))


def uri(path: str) -> str:
    """The path as pyarrow takes it: Hadoop writes file:/x for file:///x."""
    return re.sub(r"^file:/(?!//)", "file:///", path)


def open_file(path: str) -> NativeFile:
    system, inner = fs.FileSystem.from_uri(uri(path))
    return system.open_input_file(inner)


def create_file(path: str) -> NativeFile:
    """A new file to be written in order; its folder is made."""
    system, inner = fs.FileSystem.from_uri(uri(path))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


class Reader:
    """Bytes of an open file by offset, through one block that is held."""

    def __init__(self, file: NativeFile, block: int = 1 << 18):
        self.file, self.size, self.block, self.at, self.held = file, file.size(), block, 0, b""

    def read(self, offset: int, n: int) -> bytes:
        """Up to n bytes from an offset; fewer at the file's end."""
        if not self.at <= offset or offset + n > self.at + len(self.held):
            self.at = offset
            self.held = self.file.read_at(min(max(n, self.block), max(0, self.size - offset)), offset)
        return self.held[offset - self.at : offset - self.at + n]

    def some(self, offset: int, n: int) -> bytes:
        """As read, but what is held is enough if it has a byte at all."""
        ahead = self.at + len(self.held) - offset
        return self.read(offset, min(n, ahead) if self.at <= offset and ahead > 0 else n)

    def find(self, sign: bytes, offset: int, end: int) -> int:
        """The first place of a sign from offset on and before end; -1 if there is none. The sign may reach beyond end."""
        while offset < end:
            part = self.read(offset, min(self.block, end + len(sign) - 1 - offset))
            at = part.find(sign)
            if 0 <= at and offset + at < end:
                return offset + at
            if len(part) < len(sign):
                return -1
            offset += len(part) - len(sign) + 1
        return -1
