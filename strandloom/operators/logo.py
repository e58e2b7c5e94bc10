"""Sequence logos as data: binomial log odds, stacked bars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.dist import dense, uniform
from strandloom.schema import BASE_COLOURS, RESIDUES, TableInfo

_TINY = math.log(5e-324)
#: A letter that the background lacks is taken to be this much rarer than its rarest one.
VANISHING = 1e-5


def _log_beta_ratio(a: float, b: float, x: float) -> float:
    """ln of the regularised incomplete beta function, by Lentz's continued fraction on the side where it converges."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        other = _log_beta_ratio(b, a, 1 - x)
        return math.log(-math.expm1(other)) if other < -1e-300 else -math.inf
    front = a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front + math.log(h)


def tails(k: float, n: float, p: float) -> tuple[float, float]:
    """(ln Pr(X >= k), ln Pr(X <= k)) for a binomial X of n trials."""
    k = math.floor(k)
    above = 0.0 if k <= 0 else -math.inf if k > n else _log_beta_ratio(k, n - k + 1, p)
    below = 0.0 if k >= n else _log_beta_ratio(n - k, k + 1, 1 - p)
    return above, below


def log_odds(k: float, n: float, p: float, natural=False, exact=False) -> float:
    """-(ln Pr(X >= k) - ln Pr(X <= k)), in base 10 unless ``natural``; probabilities below the least double count as 0 unless ``exact``."""
    above, below = (t if exact or t >= _TINY else -math.inf for t in tails(k, n, p))
    out = below - above
    return out if natural else out * math.log10(math.e)


def cap(n: float, p: float, natural=False) -> float:
    """The largest finite log odds among counts of ``n`` trials at frequency ``p``: Pr(X >= k) falls with k, so the last
    count whose probability is still a double is found by bisection."""
    low, high = 1, math.floor(n)
    if high < 1 or math.isinf(log_odds(low, n, p, natural)):
        raise ArithmeticError("no finite log odds for these counts")
    while low < high:
        mid = (low + high + 1) // 2
        if math.isinf(log_odds(mid, n, p, natural)):
            high = mid - 1
        else:
            low = mid
    return log_odds(low, n, p, natural)


def significance(alpha: float, cells: int) -> float:
    """Height beyond which a letter is significant, after correction for all cells."""
    a = alpha / cells
    return -math.log10(a / (1 - a))


def plogo(count: DataFrame, info: TableInfo, background: DataFrame | None = None, *, natural=False, exact=False) -> DataFrame:
    """(position, letter, log_odds) of a count distribution, zeros included; infinite values are capped unless ``exact``."""
    grid = dense(count).withColumn("n", F.sum("value").over(Window.partitionBy("position")))
    if background is None:
        grid = grid.withColumn("p", F.lit(uniform(info)))
    else:
        grid = grid.join(background.select("position", "letter", F.col("value").alias("p")), ["position", "letter"], "left").na.fill(0.0, ["p"])

    @F.pandas_udf("double")
    def odds(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([log_odds(*x, natural, exact) for x in zip(k, n, p, strict=True)], dtype="float64")

    out = grid.select("position", "letter", "n", "p", odds(F.col("value").cast("double"), F.col("n").cast("double"), "p").alias("log_odds"))
    if exact:
        return out.select("position", "letter", "log_odds")
    big = F.abs("log_odds") == float("inf")
    most, null, seen = out.agg(F.max("n"), F.min(F.when(F.col("p") > 0, F.col("p"))), F.max(F.when(~big, F.abs("log_odds")))).first()
    limit = max(cap(float(most), null * VANISHING, natural), seen or 0.0) if most else 0.0
    return out.select("position", "letter", F.when(big, F.signum("log_odds") * limit).otherwise(F.col("log_odds")).alias("log_odds"))


def bars(dist: DataFrame, cutoff: float = 0.09) -> DataFrame:
    """(position, loc, letter, value, y_top, labelled): bars stacked by rising value; large ones get a label."""
    d = dist if "loc" in dist.columns else dist.withColumn("loc", F.lit(0))
    w = Window.partitionBy("position", "loc").orderBy("value", "letter").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("position", "loc", "letter", "value", F.sum("value").over(w).alias("y_top"), (F.col("value") > cutoff).alias("labelled"))


def figure(stacked: DataFrame, seq_type="NT", title="") -> dict:
    """A figure specification of stacked bars and the consensus row."""
    rows = stacked.orderBy("position", "loc", "y_top").collect()  # positions x letters
    top: dict = {}
    for r in rows:
        top[r.position, r.loc] = max(top.get((r.position, r.loc), (0, "")), (r.value, r.letter))
    colour = BASE_COLOURS if seq_type == "NT" else {k: v[1] for k, v in RESIDUES.items()}
    data = [{"type": "bar", "x": [r.position, r.loc], "y": r.value, "text": r.letter if r.labelled else "", "marker": {"color": colour.get(r.letter, "Unknown")}} for r in rows]
    return {"data": data, "layout": {"title": title, "barmode": "stack", "consensus": "".join(v for _, (_, v) in sorted(top.items()))}}


def residue_properties(spark) -> DataFrame:
    """(letter, name, kind, hydropathy): a small table for broadcast left joins."""
    return spark.createDataFrame([(k, *v) for k, v in RESIDUES.items()], "letter string, name string, kind string, hydropathy double")


def labelled(df: DataFrame, letter="letter") -> DataFrame:
    """``df`` with the residue's properties; letters without any are Unknown."""
    props = residue_properties(df.sparkSession).withColumnRenamed("letter", "__l")
    out = df.join(F.broadcast(props), F.col(letter) == F.col("__l"), "left").drop("__l")
    return out.na.fill("Unknown", ["name", "kind"])
