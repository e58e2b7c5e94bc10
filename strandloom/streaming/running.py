"""Reads as streams: row-local operators work unchanged, distributions run as streaming aggregates.

Keys are positions x letters, so the state is bounded and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.dist import counts
from strandloom.operators.insertions import exploded
from strandloom.schema import TableInfo
from strandloom.sources.text import parse_sam


def sam_stream(spark: SparkSession, directory: str, **options) -> DataFrame:
    """Records of SAM files as they arrive in a directory."""
    lines = spark.readStream.text(directory).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    return parse_sam(lines, **options)


def running_distribution(stream: DataFrame, info: TableInfo, positions=None, ignore=()) -> DataFrame:
    """(position, letter, value) so far; for output modes complete and update."""
    return counts(stream, info, positions, ignore)


def running_insertions(stream: DataFrame, info: TableInfo) -> DataFrame:
    """(position, loc, n) so far."""
    return exploded(stream, info, keep=()).groupBy("position", "loc").agg(F.count("*").alias("n"))


def to_memory(df: DataFrame, name: str, checkpoint: str | None = None, mode="complete"):
    """Run what has arrived into a memory table and stop."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
