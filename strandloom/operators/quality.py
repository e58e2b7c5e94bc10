"""Read quality: filtering, masking, distributions over position bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.operators.dist import cells
from strandloom.schema import TableInfo


def _values(info) -> Column:
    return S.phred("qual", info.phred)


def passes(info: TableInfo, q: int, percent: float, ignore_null=True) -> Column:
    """At least ``percent`` of the read's bases (of those above 0) have quality ``q`` or more."""
    v = _values(info)
    good = F.size(F.filter(v, lambda x: x >= q))
    total = F.size(F.filter(v, lambda x: x > 0)) if ignore_null else F.size(v)
    return (100 * good >= F.lit(percent) * total) & ((total > 0) | (good > 0))


def filtered(df, info, q, percent, ignore_null=True) -> DataFrame:
    return df.where(passes(info, q, percent, ignore_null))


def masked(df, info, q: int, fill=None, ignore_null=True, insertions=True) -> DataFrame:
    """Bases below ``q`` become ``fill``; null qualities stay unless asked otherwise; so do insertions of null quality."""
    fill = info.fill if fill is None else fill
    floor = 0 if ignore_null else -1
    low = F.zip_with(S.letters("seq"), _values(info), lambda c, x: F.when((x < q) & (x > floor), F.lit(fill)).otherwise(c))
    out = df.withColumn("seq", F.array_join(low, ""))
    if insertions and info.has_insertions:
        out = out.withColumn("insertions", F.filter("insertions", lambda i: (i["q"] >= q) | (i["q"] <= floor)))
    return out


def bins_of(info: TableInfo, bins="even") -> list[tuple[str, int, int]]:
    """(name, first, last) of 'even', 'fastqc' or given bins; bins that begin outside the table are left out."""
    positions = info.positions
    if bins == "fastqc":
        # The report's bins: single positions to 9, then fives (there is none from 75), tens from 300.
        pairs = [(p, p) for p in range(1, 10)] + [(p, p + 4) for p in range(10, 300, 5) if p != 75] + [(p, p + 9) for p in range(300, len(positions), 10)]
    elif bins == "even":
        step = max(1, len(positions) // 10)
        pairs = [(positions[i], positions[min(i + step, len(positions)) - 1]) for i in range(0, len(positions), step)]
    else:
        pairs = [b if isinstance(b, tuple) else (int(b), int(b)) for b in bins]
    return [(f"{a}-{b}", int(a), int(b)) for a, b in pairs if info.first <= a <= info.last]


def distribution(df, info, bins="even", positions=None, percentiles=(10, 25, 50, 75, 90), exclude_null=True, exact=True) -> DataFrame:
    """(bin, p10 …, mean, median, min, max): qualities of all reads pooled per bin.  Percentiles interpolate linearly;
    the mean leaves out null qualities always.  ``exact=False`` takes approximate percentiles in one pass of bounded state."""
    chosen = bins_of(info, bins)
    label = F.create_map(*(F.lit(x) for name, a, b in chosen for p in range(a, b + 1) for x in (p, name)))
    c = cells(df, info, positions, keep=(), quality=True).withColumn("bin", F.try_element_at(label, F.col("position"))).where("bin is not null")
    use = F.when(F.col("q") > 0, F.col("q")) if exclude_null else F.col("q")
    wanted = [p / 100 for p in percentiles] + [0.5]
    # Counts by bin and quality are few, so percentiles need no sort of all cells.
    n = c.groupBy("bin", use.alias("v"), "q").agg(F.count("*").alias("n"))
    many = F.percentile("v", F.array(*(F.lit(p) for p in wanted)), F.col("n")) if exact else F.percentile_approx("v", F.array(*(F.lit(p) for p in wanted)), 10000)
    mean = F.try_divide(F.sum(F.when(F.col("q") > 0, F.col("q") * F.col("n"))).cast("double"), F.sum(F.when(F.col("q") > 0, F.col("n"))).cast("double"))
    out = n.groupBy("bin").agg(many.alias("__p"), mean.alias("mean"), F.min("v").cast("double").alias("min"), F.max("v").cast("double").alias("max"))
    return out.select("bin", *(F.col("__p")[i].alias(f"p{int(p)}") for i, p in enumerate(percentiles)), "mean", F.col("__p")[len(percentiles)].alias("median"), "min", "max")


def numeric(df, info) -> DataFrame:
    return df.select("read_id", _values(info).alias("q"))


def box_plots(dist: DataFrame) -> list[dict]:
    """A figure specification: one box per bin, red below 20, blue below 30, else green, by its median."""
    out = []
    for r in dist.collect():  # one row per bin
        m = r["median"]
        out.append({"type": "box", "name": r["bin"], "median": m, "q1": r["p25"], "q3": r["p75"], "lowerfence": r["p10"], "upperfence": r["p90"], "mean": r["mean"],
                    "marker": {"color": "red" if m < 20 else "blue" if m < 30 else "green"}})
    return out
