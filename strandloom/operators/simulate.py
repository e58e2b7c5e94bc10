"""Synthetic reads: random sequences, saturation libraries, errors, qualities, indels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.schema import IUPAC


def chance(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone, so it can sit inside lambdas and survives recomputation."""
    h = F.xxhash64(F.lit(seed), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def choose(u: Column, letters: list[tuple[str, float]]) -> Column:
    """The letter in whose share of the weights ``u`` falls."""
    total, run, out = sum(w for _, w in letters), 0.0, None
    for c, w in letters[:-1]:
        run += w / total
        out = F.when(u < run, c) if out is None else out.when(u < run, c)
    return F.lit(letters[-1][0]) if out is None else out.otherwise(letters[-1][0])


def sequences(spark: SparkSession, n: int, length: int = 100, letters="ACTG", weights=None, seed: int = 1) -> DataFrame:
    """(read_ord, seq): independent letters."""
    pairs = list(zip(letters, weights or [1.0] * len(letters), strict=True))
    made = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda p: choose(chance(seed, F.col("read_ord"), p), pairs))
    return spark.range(1, n + 1).select(F.col("id").alias("read_ord")).withColumn("seq", F.array_join(made, "") if length > 0 else F.lit(""))


def error_prone(df: DataFrame, rate: float, spared=(), seed: int = 2) -> DataFrame:
    """Each base, but for positions in ``spared``, becomes a random one (perhaps itself) with probability ``rate``."""
    bases = [(c, 1.0) for c in "ACTG"]
    spare = F.array(*(F.lit(int(p)) for p in spared)).cast("array<int>")
    change = lambda c, i: F.when((chance(seed, F.col("read_ord"), i) < rate) & ~F.array_contains(spare, i + 1), choose(chance(seed + 1, F.col("read_ord"), i), bases)).otherwise(c)
    return df.withColumn("seq", F.array_join(F.transform(S.letters("seq"), change), ""))


def library(spark: SparkSession, scaffold: str, n: int, *, saturated=(), codes=None, default="N", error_rate=0.0, spared=(), seed: int = 3) -> DataFrame:
    """(read_ord, seq): the scaffold with saturated positions drawn from a degenerate code or (letter, weight) pairs, then errors."""
    codes = codes or {}
    seq = F.lit(scaffold.upper())
    for p in saturated:
        code = codes.get(p, default)
        pairs = [(c, 1.0) for c in IUPAC[code]] if isinstance(code, str) else list(code)
        seq = F.overlay(seq, choose(chance(seed, F.col("read_ord"), F.lit(p)), pairs), F.lit(p), F.lit(1))
    out = spark.range(1, n + 1).select(F.col("id").alias("read_ord"), ).withColumn("seq", seq)
    return error_prone(out, error_rate, spared, seed + 1) if error_rate > 0 else out


def qualities(df: DataFrame, *, read="r1", least=0, most=40, begin=36.0, end=15.0, deviation=5.0, phred=33, seed: int = 5) -> DataFrame:
    """``df`` with qual: a logarithmic fall of the mean from ``begin`` to ``end``, normal noise, clipped.

    ``deviation`` may be a function of the position (a Column, from 0)."""
    n = F.length("seq")
    slope = (F.lit(end) - begin) / F.ln(1 / (n + 1.0))

    def one(i):
        at = (n - 1 - i) if read == "r1" else i
        mean = -slope * F.ln(at + 1.0) + begin if read == "r2" else slope * F.ln(at + 1.0) + end
        noise = F.sqrt(-2 * F.ln(1 - chance(seed, F.col("read_ord"), i))) * F.cos(2 * math.pi * chance(seed + 1, F.col("read_ord"), i))
        spread = deviation(i) if callable(deviation) else F.lit(float(deviation))
        return F.char((F.least(F.greatest(F.round(mean + noise * spread), F.lit(float(least))), F.lit(float(most))) + phred).cast("int"))

    return df.withColumn("qual", F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one), "")).otherwise(""))


def indels(df: DataFrame, *, insertion=0.001, deletion=0.01, expected=1.0, quality=20, deviation=3, phred=33, most=20, seed: int = 7) -> DataFrame:
    """Bases go with probability ``deletion``; after a base, with probability ``insertion``, a Poisson number (one at least) of random ones come."""
    cumulative, p, run = [], math.exp(-expected), 0.0
    for k in range(most):
        run += p
        cumulative.append(run)
        p *= expected / (k + 1)
    bases = [(c, 1.0) for c in "ACTG"]

    def u(tag, *k):
        return chance(seed + tag, F.col("read_ord"), *k)

    def extra(i, what):
        count = F.greatest(sum(((u(2, i) >= c).cast("int") for c in cumulative), F.lit(0)), F.lit(1))
        letters = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda j: what(i, j)), "")
        return F.when(u(1, i) < insertion, letters).otherwise("")

    def body(c, what):
        return F.array_join(F.transform(S.letters(c), lambda x, i: F.concat(F.when(u(0, i) < deletion, "").otherwise(x), extra(i, what))), "")

    made = {"seq": body("seq", lambda i, j: choose(u(3, i, j), bases))}
    if "qual" in df.columns:
        made["qual"] = body("qual", lambda i, j: F.char((F.lit(quality) + F.round((u(4, i, j) - 0.5) * 2 * deviation) + phred).cast("int")))
    return df.withColumns(made)


def scratch(spark: SparkSession, n: int, length: int, saturated=(), error_rate=0.01, seed: int = 11) -> DataFrame:
    """(read_ord, seq, qual) around one random scaffold of ``length``."""
    scaffold = sequences(spark, 1, length, seed=seed).first().seq
    return qualities(library(spark, scaffold, n, saturated=saturated, error_rate=error_rate, seed=seed + 1), seed=seed + 9)
