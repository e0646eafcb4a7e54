"""Sketches as table functions of SQL:

    register(spark)
    spark.sql("SELECT * FROM minimizers(TABLE(SELECT id, seq FROM reads), 31, 15)")
    spark.sql("SELECT * FROM syncmers(TABLE(reads), k => 21, s => 11, seq => 'bases')")

The result has the table's columns without the sequence, and idx and code. Parameters are those of the sketch, in its order or
by name. Rows that the sketch can't take (null, too short, an illegal base) give none.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .sketches import SKETCHES, codes_of


@dataclass
class Planned(AnalyzeResult):
    """The result's columns, the sequence's column, and the sketch's parameters."""

    seq: str = "seq"
    parameters: tuple[tuple[str, object], ...] = ()


def table_function(kind: str) -> type:
    names = list(inspect.signature(SKETCHES[kind]).parameters)

    class Sketch:
        def __init__(self, planned: Planned):
            self.seq, self.shape = planned.seq, SKETCHES[kind](**dict(planned.parameters))

        @staticmethod
        def analyze(table: AnalyzeArgument, *places: AnalyzeArgument, **named: AnalyzeArgument) -> Planned:
            if not table.isTable:
                raise ValueError(f"the first argument of {kind} must be a table")
            if len(places) > len(names):
                raise ValueError(f"{kind} takes {', '.join(names)}")
            given = dict(zip(names, places, strict=False)) | named
            seq = given.pop("seq").value if "seq" in given else "seq"
            fields = table.dataType.fields
            if seq not in [f.name for f in fields]:
                raise ValueError(f"the table has no column {seq}")
            parameters = tuple((k, a.value) for k, a in given.items())
            SKETCHES[kind](**dict(parameters))  # refuses what it can't take
            kept = [StructField(f.name, f.dataType, True) for f in fields if f.name != seq]
            return Planned(StructType([*kept, StructField("idx", IntegerType()), StructField("code", LongType())]), seq=seq, parameters=parameters)

        def eval(self, row: Row, *places: object, **named: object) -> Iterator[tuple]:
            seq = row[self.seq]
            if seq is None:
                return
            try:
                idx, code = codes_of(seq, self.shape)
            except ValueError:
                return
            kept = [row[c] for c in row.__fields__ if c != self.seq]
            for i, c in zip(idx.tolist(), code.view("int64").tolist(), strict=True):
                yield (*kept, i, c)

    Sketch.__name__ = kind
    return Sketch


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session, by the names of SKETCHES."""
    for kind in SKETCHES:
        spark.udtf.register(kind, udtf(table_function(kind)))
