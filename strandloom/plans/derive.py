"""Deterministic reads derived from the driver's tables, alike in Spark and DuckDB.

A read's letters come from the md5 of its key: a hex digit below c keeps the wild type's
base, c to f replace it; qualities, CIGARs, flags and names follow from the key too.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.operators.table import SeqTable
from strandloom.schema import INSERTIONS, TableInfo

WT = "ACGTTGCAAGCTTCGAGGATCCATGCAATTGC"
_HEX, _QUAL = "0123456789abcdef", "!#(-27:=?ADEFGHI"


def _seq(key: Column) -> Column:
    pairs = F.zip_with(S.letters(F.md5(key.cast("string"))), S.letters(F.lit(WT)), lambda x, w: F.when(x < "c", w).otherwise(F.translate(x, "cdef", "ACGT")))
    return F.array_join(pairs, "")


def _qual(key: Column) -> Column:
    return F.translate(F.md5(F.concat(F.lit("q"), key.cast("string"))), _HEX, _QUAL)


def keyed(df: DataFrame, key: str, weight=None) -> DataFrame:
    k = F.col(key)
    return df.select(k.alias("read_id"), k.alias("read_ord"), _seq(k).alias("seq"), _qual(k).alias("qual"), F.array().cast(INSERTIONS).alias("insertions"), *([F.col(weight).alias("weight")] if weight else []))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark, sf_dir) -> SeqTable:
    return SeqTable(keyed(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice"), TableInfo(first=1, last=len(WT)))


def reads2(spark, sf_dir, first=5) -> SeqTable:
    return SeqTable(keyed(table(spark, sf_dir, "customer"), "c_custkey"), TableInfo(first=first, last=first + len(WT) - 1))


def references(spark, sf_dir, n=5) -> list[str]:
    """Fixed variants of the wild type, the reads of keys 1 to ``n``: a list that doesn't grow with the data."""
    return [r.seq for r in keyed(spark.range(1, n + 1), "id").orderBy("read_ord").collect()]


def sam(spark, sf_dir) -> DataFrame:
    k = F.col("read_id")
    base = keyed(table(spark, sf_dir, "orders"), "o_orderkey")
    cigar = F.when(k % 8 <= 4, "32M").when(k % 8 == 5, "10M2I20M").when(k % 8 == 6, "12M3D20M").otherwise("4S28M")
    flag = F.get(F.array(*(F.lit(x) for x in (0, 16, 4, 99, 147, 512, 1024, 83))), (F.floor(k / 8) % 8).cast("int"))
    rname = F.when(k % 50 == 0, "*").when(k % 33 == 0, "phiX").otherwise("ref")
    return base.select(k.alias("read_id"), "read_ord", k.cast("string").alias("header"), flag.alias("flag"), rname.alias("rname"), (1 + k % 5).cast("int").alias("pos"), (k % 61).cast("int").alias("mapq"),
                       cigar.alias("cigar"), F.lit("=").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual")


def projected(spark, sf_dir, first=None, last=None) -> SeqTable:
    return SeqTable.from_df(sam(spark, sf_dir), index="read_id", first=first, last=last)


def paired(spark, sf_dir) -> DataFrame:
    """Alignments whose even and odd neighbours are mates: they share a header."""
    k = F.col("read_id")
    return sam(spark, sf_dir).withColumns({"header": (k - k % 2).cast("string"), "flag": F.when(k % 2 == 0, 99).otherwise(147)})


def saved(spark, name: str, write) -> str:
    """A fresh path below the shared folder, filled by ``write(path)``; a temporary one only where the session runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(path)
    return path


def amino_pieces(spark, sf_dir) -> SeqTable:
    """Whole documents as consecutive reads of 40 letters; the last one is filled up with X, null texts have none."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    letters = d.select("doc_id", F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^A-Z]", "X").alias("s"))
    pieces = letters.select("doc_id", F.explode(F.expr("transform(sequence(0, greatest(length(s) - 1, 0) div 40), i -> struct(i, rpad(substring(s, int(i * 40 + 1), 40), 40, 'X') as seq))")).alias("x"))
    df = pieces.select(F.concat_ws(":", "doc_id", "x.i").alias("read_id"), F.struct("doc_id", "x.i").alias("read_ord"), F.col("x.seq").alias("seq"), F.lit(None).cast("string").alias("qual"), F.array().cast(INSERTIONS).alias("insertions"))
    return SeqTable(df, TableInfo("AA", 1, 40, has_quality=False))
