"""Letter distributions per position and what follows from them: entropy, bits, consensus.

Positions are pruned by substring before the explode, so a distribution over a few
positions reads and shuffles only those; counts are combined map-side, at most
positions x letters rows leave a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.schema import AMINO, DNA, TableInfo

Q6 = 6


def runs(positions: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive positions, in the given order."""
    out: list[list[int]] = []
    for p in positions:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def checked(info: TableInfo, positions) -> list[int]:
    """The asked positions that exist, in the caller's order, each once."""
    import warnings

    if positions is None:
        return info.positions
    asked = list(dict.fromkeys(positions))
    have = set(info.positions)
    if missing := [p for p in asked if p not in have]:
        warnings.warn(f"positions outside the table are left out: {missing[:10]}", stacklevel=3)
    return [p for p in asked if p in have]


def cells(df: DataFrame, info: TableInfo, positions=None, keep=("read_id",), quality=False) -> DataFrame:
    """One row per read and position: position, base and, on request, q."""
    parts = runs(checked(info, positions))
    keep = [F.col(k) for k in keep]
    if not parts:
        return df.select(*keep, F.lit(0).alias("position"), F.lit("").alias("base"), *([F.lit(0).alias("q")] if quality else [])).limit(0)

    def pick(c):
        bits = [F.split(F.substring(c, a - info.first + 1, b - a + 1), "") for a, b in parts]
        return bits[0] if len(bits) == 1 else F.concat(*bits)

    letters = pick("seq")
    if len(parts) == 1:
        where = lambda i: i + F.lit(parts[0][0])
    else:
        all_positions = F.array(*(F.lit(p) for a, b in parts for p in range(a, b + 1)))
        where = lambda i: F.get(all_positions, i)
    if not quality:
        out = df.select(*keep, F.posexplode(letters).alias("__i", "base"))
        return out.select(*keep, where(F.col("__i")).alias("position"), "base")
    both = F.arrays_zip(letters.alias("base"), pick("qual").alias("c"))
    out = df.select(*keep, F.posexplode(both).alias("__i", "x"))
    return out.select(*keep, where(F.col("__i")).alias("position"), F.col("x.base").alias("base"), (F.ascii("x.c") - info.phred).alias("q"))


def counts(df, info, positions=None, ignore=(), weight=None) -> DataFrame:
    """(position, letter, value): how often, or with which weight, a letter stands at a position."""
    c = cells(df, info, positions, keep=[weight] if weight else [])
    if ignore:
        c = c.where(~F.col("base").isin(*ignore))
    value = F.sum(F.col(weight).cast("double")) if weight else F.count("*")
    return c.groupBy("position", F.col("base").alias("letter")).agg(value.alias("value"))


def frequencies(count: DataFrame, by=("position",)) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy(*by))
    return count.withColumn("value", F.try_divide(F.col("value").cast("double"), total))


def bits(freq: DataFrame, reads: int, letters: int, by=("position",)) -> DataFrame:
    """Letter heights in bits, small-sample corrected, not below 0."""
    h = F.sum(-F.col("value") * F.ln("value") / math.log(2)).over(Window.partitionBy(*by))
    correction = (letters - 1) / (2 * reads * math.log(2)) if reads else 0.0
    return freq.withColumn("value", F.greatest(F.lit(0.0), F.col("value") * (F.lit(math.log2(letters) if letters else 0.0) - (h + correction / 2))))


def seq_dist(df, info, positions=None, method="counts", ignore=(), weight=None, insertions=False, alphabet=None) -> DataFrame:
    """Distribution by ``method``: counts, freq or bits.  ``insertions`` adds a letter ^ with the reads that have one there."""
    out = counts(df, info, positions, ignore, weight)
    if insertions and info.has_insertions:
        events = df.select(F.explode("insertions").alias("i")).where("i.loc = -1").where(F.col("i.position").isin(checked(info, positions)))
        events = events.groupBy(F.col("i.position").alias("position")).agg(F.count("*").cast(out.schema["value"].dataType).alias("value"))
        out = out.unionByName(events.select("position", F.lit("^").alias("letter"), "value"))
    if method == "counts":
        return out
    if method == "freq":
        return frequencies(out)
    if method != "bits":
        raise ValueError(f"method must be counts, freq or bits, not {method!r}")
    size = len(alphabet) if alphabet else out.agg(F.countDistinct("letter")).first()[0]
    return bits(frequencies(out), df.count(), size)


def entropy(freq: DataFrame, base: int = 2) -> DataFrame:
    """(position, entropy) in units of log ``base``."""
    return freq.groupBy("position").agg(F.sum(-F.col("value") * F.ln("value") / math.log(int(base))).alias("entropy"))


def diversity(freq: DataFrame) -> DataFrame:
    """(position, diversity): the effective number of letters."""
    return freq.groupBy("position").agg(F.exp(F.sum(-F.col("value") * F.ln("value"))).alias("diversity"))


def uniform(info: TableInfo) -> float:
    return 1 / len(AMINO if info.seq_type == "AA" else DNA)


def relative_entropy(freq: DataFrame, info: TableInfo, background: DataFrame | None = None) -> DataFrame:
    """(position, relative_entropy) in nats, against a background distribution or a uniform one."""
    if background is None:
        joined = freq.withColumn("b", F.lit(uniform(info)))
    else:
        joined = freq.join(background.select("position", "letter", F.col("value").alias("b")), ["position", "letter"])
    return joined.groupBy("position").agg(F.sum(F.col("value") * F.ln(F.try_divide("value", "b"))).alias("relative_entropy"))


def strict_majority(count: DataFrame, cutoff: float, by=("position",), unknown="N") -> DataFrame:
    """The most frequent letter (least in ASCII of equals), or ``unknown`` where it has no more than ``cutoff`` of all."""
    top = F.max_by("letter", F.struct("value", -F.ascii("letter")))
    return count.groupBy(*by).agg(F.when(F.max("value") <= F.sum("value") * cutoff, unknown).otherwise(top).alias("letter"))


def consensus_letters(df, info, positions=None, cutoff=0.5, insertions=True, drop_gaps=True) -> DataFrame:
    """(position, loc, letter) of the consensus; loc 0 is the base, loc < 0 what is inserted before it."""
    out = strict_majority(counts(df, info, positions), cutoff).withColumn("loc", F.lit(0))
    if insertions and info.has_insertions:
        from strandloom.operators.insertions import letter_dist

        ins = strict_majority(letter_dist(df, info, positions), cutoff, ("position", "loc"))
        if drop_gaps:
            ins = ins.where("letter <> '-'")
        out = out.unionByName(ins)
    return out.select("position", "loc", "letter")


def consensus(df, info, **options) -> DataFrame:
    """One row with the consensus string: at most one letter per column is brought together."""
    return consensus_letters(df, info, **options).agg(F.expr("listagg(letter, '') within group (order by position, loc)").alias("consensus"))


def wide(dist: DataFrame, letters: list[str] | None = None) -> DataFrame:
    """Letters as rows, positions as columns, zeros filled in; for display."""
    return dist.groupBy("letter").pivot("position").agg(F.first("value")).na.fill(0).orderBy("letter")


def dense(count: DataFrame) -> DataFrame:
    """All letters x positions of a distribution, zeros included.  Both lists are tiny: letters of an alphabet, positions of a read."""
    grid = count.select("position").distinct().crossJoin(F.broadcast(count.select("letter").distinct()))
    return grid.join(count, ["position", "letter"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def rounded(c, places: int = Q6) -> Column:
    return F.round(c, places)
