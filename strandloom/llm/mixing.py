"""Mix sources to target weights.

The words of a source, document after document in hash order, form its stream; the
stream is packed into blocks of ``block`` words (the last may be short).  Targets
share the corpus by weight, none above ``most`` times its source.  A source's target
is laid out as slots: epoch after epoch, each epoch a keyed permutation of the full
blocks, closed by the short one; the last slot is trimmed so that the words taken are
the target's whole words.  Output shards of ``shard_slots`` slots draw how many slots
they take from each source: multinomial draws under the condition that all shards
together use up the targets exactly.  Slots then meet the blocks by index.

Only the table of sources (one row each, at most ``max_sources``) and the top of the
tree of draws go through the driver.  A source's stream is cut by hash into as many buckets as its rows
ask for, so that a source with a third of all rows is never one task; equal rows are counted before they are shuffled.

Defined cases: null and empty texts have no words and are taken 0 times; very long texts
span blocks and are counted whole; a null source is a source, the last; a null id is an
id; repeated rows are documents of their own; an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.llm.permute import permuted
from strandloom.llm.sharding import hypergeometric

SEED = 20240503
_KEYS = ["__a", "__b"]


def shares(sizes: list[int], weights=(1, 2, 3), most: int = 3) -> list[float]:
    """Targets of sources in order: weighted shares of the sum, capped at ``most`` times a size."""
    total = sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        rate = left / sum(weight[i] for i in free)
        over = [i for i in sorted(free) if weight[i] * rate > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = weight[i] * rate
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


class Mix:
    """The tables of one mix: ``docs`` (one row per distinct row, with copies), ``sources``, ``slots``."""

    def __init__(self, docs: DataFrame, *, text="text", source="source", ident="doc_id", block=1024, shard_slots=4096,
                 weights=(1, 2, 3), most=3, seed=SEED, max_sources=100_000, bucket_rows=2_000):
        spark = docs.sparkSession
        self.block, self.most, self.seed = block, most, seed
        keyed = docs.select(common.q(ident).alias("__id"), common.q(source).alias("__source"),
                            word_count(common.q(text)).alias("__size"), *row_keys(docs, ident, source, text))
        self.docs = common.written(keyed.groupBy("__id", "__source", "__size", *_KEYS).agg(F.count("*").alias("__copies")), "mix")
        rows = self.docs.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"over {max_sources} sources: merge small ones or raise max_sources")
        rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
        self.names, sizes = [r[0] for r in rows], [r.n for r in rows]
        targets = shares(sizes, weights, most)
        plan, slots = [], []
        for k, (size, target) in enumerate(zip(sizes, targets, strict=True)):
            words = min(int(target), most * size)
            each = -(-size // block)
            slots.append((words // size) * each + -(-(words % size) // block) if size else 0)
            plan.append((k, self.names[k], size, target, words, each, min(1 << 20, max(1, math.ceil(rows[k].rows / bucket_rows)))))
        self.sources = spark.createDataFrame(plan, "__k int, __source string, source_size long, target double, __words long, __each long, __buckets long")
        self.drawn = draws(spark, slots, shard_slots, seed)
        self._streams = None

    def streams(self) -> DataFrame:
        """Each document copy with its source number and the place of its first word in the stream; made once."""
        if self._streams is None:
            self._streams = common.written(self._laid_out(), "streams")
        return self._streams

    def _laid_out(self) -> DataFrame:
        d = self.docs.join(F.broadcast(self.sources), self.docs["__source"].eqNullSafe(self.sources["__source"])).drop(self.sources["__source"])
        d = d.withColumn("__bucket", F.pmod("__a", "__buckets").cast("int"))
        length = F.col("__size") * F.col("__copies")
        # One row per source and bucket.
        ahead = d.groupBy("__k", "__bucket").agg(F.sum(length).alias("__n"))
        ahead = ahead.withColumn("__base", F.sum("__n").over(Window.partitionBy("__k").orderBy("__bucket")) - F.col("__n"))
        run = Window.partitionBy("__k", "__bucket").orderBy(*_KEYS)
        d = d.withColumn("__at", F.sum(length).over(run) - length)
        d = d.join(ahead.drop("__n"), ["__k", "__bucket"])
        copies = d.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
        return copies.withColumn("__at", F.col("__base") + F.col("__at") + F.col("__copy") * F.col("__size")).drop("__base", "__bucket", "__buckets", "__copies")

    def pieces(self) -> DataFrame:
        """The part of each document copy in each block: __o words into the block, __from words into the document."""
        s = self.streams().where("__size > 0")
        size = F.lit(self.block).cast("long")
        last = F.expr(f"(__at + __size - 1) div {self.block}")
        s = s.withColumn("__block", F.explode(F.sequence(F.expr(f"__at div {self.block}"), last)))
        begin = F.greatest(F.col("__block") * size, F.col("__at"))
        end = F.least((F.col("__block") + 1) * size, F.col("__at") + F.col("__size"))
        return s.select("__k", "__block", "__id", *_KEYS, "__copy", "__size",
                        (begin - F.col("__block") * size).alias("__o"), (begin - F.col("__at")).alias("__from"), (end - begin).alias("__len"))

    def slots(self) -> DataFrame:
        """Every slot: shard, its place there, source number, epoch, block, and the words it takes of the block."""
        s = self.drawn.repartition("shard", "__k").join(F.broadcast(self.sources.drop("__source", "__buckets")), "__k")
        s = s.withColumn("__j", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__count") - 1)))
        block = F.lit(self.block).cast("long")
        s = s.withColumns({
            "epoch": F.expr("cast(__j div __each as int)"),
            "__q": F.expr("__j % __each"),
            "place": permuted(F.col("__off") + F.col("__j") - F.col("__first"), F.col("__full"), self.seed, "shard", F.col("shard")),
        })
        full = F.expr(f"source_size div {self.block}")
        s = s.withColumn("__block", F.when(F.col("__q") < full, permuted(F.col("__q"), F.greatest(full, F.lit(1)), self.seed, "epoch", F.col("__k"), F.col("epoch"))).otherwise(full))
        left = F.col("__words") - F.col("epoch") * F.col("source_size") - F.col("__q") * block
        return s.select("shard", "place", "__k", "epoch", "__block", F.least(left, block).alias("__limit"))

    def mixed(self) -> DataFrame:
        """The mix: for each slot the document pieces it takes."""
        used = F.least(F.col("__limit") - F.col("__o"), F.col("__len"))
        joined = self.slots().join(self.pieces(), ["__k", "__block"])
        return joined.withColumn("words", used).where("words > 0").drop("__limit", "__len")

    def taken(self) -> DataFrame:
        """Every document with source_size, target and the words taken of it."""
        counts = self.mixed().groupBy(*_KEYS, "__copy").agg(F.sum("words").alias("taken"))
        out = self.streams().join(counts, [*_KEYS, "__copy"], "left")
        return out.select(F.col("__id"), F.col("__size").cast("long").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def halves(lo: int, hi: int, left: list[tuple], shard_slots: int, seed: int):
    """Split the shards lo..hi-1 and what they take, (source, count, first slot), in two halves.

    The left half's counts are multivariate hypergeometric, so sources' counts in a shard
    are multinomial under the condition that the shards together take all counts."""
    mid = (lo + hi) // 2
    rng, rest = np.random.default_rng([seed, lo, hi]), sum(c for _, c, _ in left)
    n = min(shard_slots * (mid - lo), rest)
    one, other = [], []
    for k, m, first in left:
        rest -= m
        c = hypergeometric(rng, m, rest, n) if n else 0
        n -= c
        if c:
            one.append((k, c, first))
        if c < m:
            other.append((k, m - c, first + c))
    return (lo, mid, one), (mid, hi, other)


_DRAWN = "shard long, __k int, __first long, __count long, __off long, __full long"


def _leaves(shard_slots, seed):
    """All draws of one group of shards."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        todo, out = [(got["lo"][0], got["hi"][0], sorted(zip(got["k"], got["n"], got["first"], strict=True)))], []
        while todo:
            lo, hi, left = todo.pop()
            if hi - lo > 1:
                todo += halves(lo, hi, left, shard_slots, seed)
                continue
            off, full = 0, sum(c for _, c, _ in left)
            for k, c, first in left:
                out.append((lo, k, first, c, off, full))
                off += c
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.table({name.split()[0]: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate(zip(_DRAWN.split(", "), types, strict=True))})

    return run


def draws(spark, slots: list[int], shard_slots: int, seed: int, most: int = 1 << 18) -> DataFrame:
    """(shard, source, first slot of the source, count, offset in the shard, slots of the shard) for every draw above 0.

    A binary tree of draws: its top, at most about ``most`` numbers, is drawn here, each
    group of shards below it in a task.  Every node has its own generator, so the cut doesn't show.
    """
    top = [(0, -(-sum(slots) // shard_slots), [(k, n, 0) for k, n in enumerate(slots) if n])]
    while 2 * len(top) * len(slots) <= most and any(hi - lo > 64 for lo, hi, _ in top):
        top = [x for lo, hi, left in top for x in (halves(lo, hi, left, shard_slots, seed) if hi - lo > 64 else [(lo, hi, left)])]
    rows = [(lo, hi, k, n, first) for lo, hi, left in top if hi > lo for k, n, first in left]
    common.ship(spark)
    return spark.createDataFrame(rows, "lo long, hi long, k int, n long, first long").groupBy("lo", "hi").applyInArrow(_leaves(shard_slots, seed), _DRAWN)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def row_keys(docs, ident, source, text):
    parts = [common.q(c) for c in (ident, source, text)]
    return [F.xxhash64(*parts).alias("__a"), F.xxhash64(F.lit(SEED), *parts[::-1]).alias("__b")]


def digest(docs: DataFrame) -> DataFrame:
    return Mix(docs).taken().withColumnRenamed("__id", "doc_id")


def mix_documents(docs: DataFrame, *, text="text", source="source", ident="doc_id", **options) -> DataFrame:
    """The mix as documents: one row for each run of consecutive words that an epoch takes
    from a document, columns as they came.  A run of the whole document keeps its text; a
    part has its words joined by one space.  A column n_chars follows the text."""
    names = docs.columns
    m = Mix(docs, text=text, source=source, ident=ident, **options)
    # A document of n words lies in n / block + 2 blocks, so the array is bounded by the text itself.
    runs = m.mixed().groupBy(*_KEYS, "__copy", "__size", "epoch").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__from").alias("s"), (F.col("__from") + F.col("words")).alias("e")))).alias("__p"))
    spans = F.aggregate(
        "__p", F.slice("__p", 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] == x["s"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), x["e"].alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    runs = runs.select(*_KEYS, "__copy", "__size", F.explode(spans).alias("__run"))
    # Copies of a row have equal keys and equal texts: each run needs the text once.
    texts = docs.select(*row_keys(docs, ident, source, text), F.struct(*common.numbered(names)).alias("__row"))
    texts = texts.dropDuplicates(_KEYS)
    at = f"in_{names.index(text)}"
    body = F.col(f"__row.{at}")
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(common.WORD), F.lit(0)),
                               (F.col("__run.s") + 1).cast("int"), (F.col("__run.e") - F.col("__run.s")).cast("int")), " ")
    whole = (F.col("__run.s") == 0) & (F.col("__run.e") == F.col("__size"))
    out = texts.join(runs, _KEYS).withColumn("__row", F.col("__row").withField(at, F.when(whole, body).otherwise(cut)))
    if "n_chars" in names:
        out = out.withColumn("__row", F.col("__row").withField(f"in_{names.index('n_chars')}", F.length(body).cast(docs.schema["n_chars"].dataType)))
    return out.select("__row.*").select(*common.restored(names))
