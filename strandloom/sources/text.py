"""SAM, FASTQ and FASTA text as DataFrames, and FASTQ back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mandatory SAM fields, in file order.
SAM_FIELDS = ("header", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_INTEGERS = ("flag", "pos", "mapq", "pnext", "tlen")


def read_sam(spark: SparkSession, path: str, *, tags=None, fields=SAM_FIELDS, rows: int | None = None, label: str | None = None) -> DataFrame:
    """SAM records: the wanted fields and ``tags`` (a map, or one column for each named tag).  ``label`` adds the file name."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    if label:
        lines = lines.withColumn("__file", F.input_file_name())
    return parse_sam(lines, tags=tags, fields=fields, rows=rows, label=label)


def parse_sam(lines: DataFrame, *, tags=None, fields=SAM_FIELDS, rows=None, label=None) -> DataFrame:
    cols = F.split("value", "\t")
    out = lines.withColumn("__c", cols)
    made = [F.get("__c", i).alias(f) if f not in _INTEGERS else F.get("__c", i).try_cast("int").alias(f) for i, f in enumerate(SAM_FIELDS) if f in fields]
    extra = F.filter(F.slice("__c", 12, 1 << 20), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    names = F.transform(extra, lambda x: F.substring(x, 1, 2))
    first = F.filter(extra, lambda x, i: F.array_position(names, F.substring(x, 1, 2)) == i + 1)  # a repeated tag: its first value
    every = F.map_from_entries(F.transform(first, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.regexp_extract(x, "^[^:]*:[^:]*:(.*)$", 1).alias("value"))))
    made += [every.alias("tags")] if tags is None else [F.try_element_at(every, F.lit(t)).alias(t) for t in tags]
    out = out.select(*made, *([F.col("__file").alias(label)] if label else []))
    return out.limit(rows) if rows is not None else out


def read_fastq(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """(read_ord, header, seq, qual): records of four lines, in file order.

    Line numbers come from the lines' places in their file, so a record that spans two
    splits is put together by one narrow shuffle on (file, record)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"), "value")
    part = F.shiftright("id", 33)
    sizes = lines.groupBy("file", part.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    from pyspark.sql import Window

    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n"))  # one row per split
    at = lines.withColumn("part", part).join(F.broadcast(base), ["file", "part"]).withColumn("line", F.col("base") + F.col("id") - F.col("low"))
    record = F.expr("line div 4")
    slot = F.col("line") % 4
    out = at.groupBy("file", record.alias("record")).agg(*(F.max(F.when(slot == i, F.col("value"))).alias(c) for i, c in ((0, "header"), (1, "seq"), (3, "qual"))))
    out = out.where("header is not null and seq is not null").select("file", (F.col("record") + 1).alias("read_ord"), F.regexp_replace("header", "^@", "").alias("header"), "seq", "qual")
    return out.where(F.col("read_ord") <= limit).drop("file") if limit is not None else out.drop("file")


def write_sam(df: DataFrame, path: str, *, append=False) -> None:
    """The eleven fields and, from a map ``tags``, text tags; rows as they lie."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in _INTEGERS else "*")) for c in SAM_FIELDS]
    if "tags" in df.columns:
        fields.append(F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])))
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_fastq(df: DataFrame, path: str, *, header: str | None = "header", append=False) -> None:
    """@header, sequence, +, quality; reads without a header become insilica_seq_{number}."""
    name = F.col(header) if header and header in df.columns else F.format_string("insilica_seq_%d", F.col("read_ord") if "read_ord" in df.columns else F.monotonically_increasing_id())
    df.select(F.format_string("@%s\n%s\n+\n%s", name, F.col("seq"), F.col("qual"))).write.mode("append" if append else "overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): first word of the description line; sequence lines joined, in capitals."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    return records.select(F.regexp_extract(F.get(lines, 0), r"^\s*(\S*)", 1).alias("id"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "")).alias("seq"))
