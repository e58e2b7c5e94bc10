"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The rows are written once with their partition and their place in it, so that a
   lost executor or another split of the input can't move them between the passes.
2. On the driver, a matrix of at most ``max_partitions`` x shards numbers is drawn:
   how many rows of each partition go to each shard.  Its rows sum to the partition
   sizes and its columns to the shard sizes, distributed as a uniform permutation
   would make them (multivariate hypergeometric).
3. A keyed permutation shuffles each partition's places; the matrix cuts them into
   runs, one for each shard.
4. Rows are exchanged, and another keyed permutation of the shard's arrivals gives
   each row its slot.

Steps 3 and 4 are arithmetic on a row's own columns: no sort, no window and no key
on which rows could pile up.  Row counts of shards differ by one at most.

Defined cases: an empty table gives no rows; repeated rows are rows of their own;
nulls in any column, empty and very long texts don't matter; input columns named shard
or slot are replaced, others may have any name.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.llm.permute import permuted

_NUMPY_MOST = 10**9


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x!, by Stirling's series above 16."""
    x = np.asarray(x, np.float64)
    z = np.maximum(x, 1) + 1.0
    big = np.maximum(z, 17.0)
    series = (big - 0.5) * np.log(big) - big + 0.918938533204672742 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    small = np.cumsum(np.log(np.arange(1, 18)))
    return np.where(z >= 17.0, series, np.where(x < 1, 0.0, small[np.clip(x.astype(np.int64), 1, 17) - 1]))


def hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """One draw, for counts of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    p = good / (good + bad)
    mean, sd = n * p, (n * p * (1 - p)) ** 0.5 + 1
    k = np.arange(max(low, int(mean - 14 * sd)), min(high, int(mean + 14 * sd)) + 1)
    w = -sum(_log_factorial(v) for v in (k, good - k, n - k, bad - n + k))
    w = np.cumsum(np.exp(w - w.max()))
    return int(k[np.searchsorted(w, rng.random() * w[-1])])


def matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Random counts with the given row and column sums."""
    rng, left, out = np.random.default_rng(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for j, m in enumerate(left):
            rest -= m
            k = hypergeometric(rng, m, rest, n) if n else 0
            line.append(k)
            n -= k
        left = [m - k for m, k in zip(left, line, strict=True)]
        out.append(line)
    return out


def shard(docs: DataFrame, *, shards: int = 16, seed: int = 20240501, max_partitions: int = 4096) -> DataFrame:
    """``docs`` with shard (0..shards-1) and slot (0.. without gaps in each shard)."""
    spark = docs.sparkSession
    out = common.others(docs.columns, ("shard", "slot"))
    base = docs.select(*common.numbered(out)).coalesce(max_partitions).withColumn("place", F.monotonically_increasing_id())
    base = common.written(base, "shard")
    base = base.withColumns({"own": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r[0], r[1]) for r in base.groupBy("own").count().collect())
    total = sum(n for _, n in sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    drawn = matrix([n for _, n in sizes], room, seed)
    lines, taken = [], [0] * shards
    for (p, n), line in zip(sizes, drawn, strict=True):
        lines.append({"p": p, "n": n, "upto": np.cumsum(line).tolist(), "seen": taken})
        taken = [t + k for t, k in zip(taken, line, strict=True)]
    plan = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(lines)), "array<struct<p:bigint,n:bigint,upto:array<bigint>,seen:array<bigint>>>"))
    ).withColumnsRenamed({"p": "__p", "n": "__n", "upto": "__upto", "seen": "__seen"})
    # At most max_partitions rows of 2 * shards numbers.
    rows = base.join(F.broadcast(plan), F.col("own") == F.col("__p"))
    rows = rows.withColumn("__r", permuted(F.col("place"), F.col("__n"), seed, "local", F.col("own")))
    to = sum((F.when(F.col("__r") >= F.col("__upto")[j], 1).otherwise(0) for j in range(shards)), F.lit(0))
    rows = rows.withColumn("shard", to.cast("int"))
    before = F.when(F.col("shard") > 0, F.try_element_at("__upto", F.col("shard"))).otherwise(0)
    arrived = F.try_element_at("__seen", F.col("shard") + 1) + F.col("__r") - before
    full = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    rows = rows.withColumn("slot", permuted(arrived, full, seed, "shard", F.col("shard")))
    rows = rows.select(*common.restored(out), "shard", "slot")
    # The exchange: a shard's rows travel in spans, so that a large shard isn't one task.
    return rows.repartition("shard", F.shiftright("slot", 16))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the registered query."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(sized).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
