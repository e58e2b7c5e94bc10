"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space and the ASCII controls 9 to 13, which
#: is exactly what ``bytes.split()`` splits at.
WHITE = " \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver runs from."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary
    one where the session names none and runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote, once no unfinished reader is left."""
    for t in tables:
        delete(t.sparkSession, t.written_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def q(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(columns, made) -> list[str]:
    """``columns`` without those that the new columns ``made`` replace, whatever their case."""
    made = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in made]


def numbered(columns) -> list[Column]:
    """The columns under names of their own (in_0, in_1 ...), so that an operator's inner names can't clash."""
    return [q(c).alias(f"in_{i}") for i, c in enumerate(columns)]


def restored(columns) -> list[Column]:
    """What ``numbered`` renamed, under the names it had."""
    return [F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)]


def numbered_fields(schema: T.StructType, columns) -> list[T.StructField]:
    return [T.StructField(f"in_{i}", schema[c].dataType) for i, c in enumerate(columns)]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until it clashes with no column of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def guarded(df: DataFrame, text: str, made) -> tuple[DataFrame, str, list[str], list[Column]]:
    """For filters that return their input's columns: ``df`` under names that don't clash
    with the columns ``made`` on the way, its text column, what to keep, how to get back."""
    away = {c: fresh(df, f"__{i}_{c}") for i, c in enumerate(df.columns) if c.lower() in {m.lower() for m in made}}
    inner = df.withColumnsRenamed(away)
    keep = [away.get(c, c) for c in df.columns]
    return inner, away.get(text, text), keep, [q(k).alias(c) for k, c in zip(keep, df.columns, strict=True)]


def text_map(df, fn, fields, text="text", keep=None):
    """Run ``fn(list of texts or None) -> list of pyarrow arrays`` over Arrow batches.

    The columns ``keep`` (all but clashing ones by default) pass through, the new
    ``fields`` follow.  No shuffle: memory is bounded by one Arrow batch.
    """
    ship(df.sparkSession)
    new = T.StructType(fields)
    keep = others(df.columns if keep is None else keep, new.names)
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*numbered(keep), *([] if text in keep else [q(text).alias("t")]))
    schema = T.StructType(numbered_fields(df.schema, keep) + new.fields)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *fn(part.column(at).to_pylist())], names=schema.names)

    return source.mapInArrow(run, schema).select(*restored(keep), *new.names)


def slices(column, limit: int = 8 << 20):
    """Row ranges of about ``limit`` bytes of text each, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
