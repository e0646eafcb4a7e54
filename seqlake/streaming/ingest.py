"""Extension: sequence files that arrive in a folder, as a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequence import gc
from ..operators.stats import length_stats
from ..sources.fastx import fasta_records


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 100, **options: str) -> DataFrame:
    """Records of the FASTA files that land in a folder: id, name, desc, seq, qual (null). Stateless: no watermark is needed."""
    values = spark.readStream.format("text").option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).options(**options).load(folder)
    return fasta_records(values.select("value"))


def running_composition(records: DataFrame) -> DataFrame:
    """Number of records, bases and mean GC content so far; for output mode complete or update."""
    return records.agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"), F.avg(gc(F.col("seq"))).alias("gc"))


def running_length_stats(records: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, length: str = "length", by: list[str] | None = None, **trigger: object) -> StreamingQuery:
    """Length statistics of all that a stream has brought so far, given to to(statistics, number of the trigger) after each trigger.

    What is kept between triggers is the histogram: a row for each length of a group, whose counts new files add to; it is
    Spark's aggregation state, so it survives lost executors and restarts from the checkpoint. Hinges, N50 and the others are made
    of it as in batch.
    """
    groups = by or []
    counted = records.where(F.col(length).isNotNull()).groupBy(*groups, F.col(length).cast("long").alias(length)).agg(F.count("*").alias("__n"))

    def each(histogram: DataFrame, number: int) -> None:
        histogram.persist()
        to(length_stats(histogram, length, groups, n="__n"), number)
        histogram.unpersist()

    writer = counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
