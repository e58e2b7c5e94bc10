"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

1. A document's shingles become a sorted set of 64-bit hashes.  Documents with equal
   sets are one class; its members need no comparison.
2. A class has ``TREES`` x ``DEPTH`` MinHash values.  A tree sorts the classes by its
   ``DEPTH`` values.  A region is a run of at least two rows of that order with
   ``LEAST`` equal leading values; classes alone in all trees are done.
3. In a region, rows are paired with their neighbours by longest common prefix: a
   region of up to ``PAIRS`` rows whole, a larger one split by deeper prefixes until
   its parts are that small (a part that no prefix splits is a candidate as a whole),
   and every row with its next ``NEAR`` rows.  Pairs whose
   signatures agree in 60 % of the values are kept, reduced in place to a spanning
   forest, so a region of n rows sends less than n pairs.  Regions too large for one
   task go by the full depth, then by salt, with one edge to the region's least row.
4. Connected candidates form candidate components.  Each holds all links among its
   classes, so links are confirmed there, on full sets and for all its pairs, by
   blocks of ``BLOCK`` classes.
5. Links again are sent as forests; components are found by alternating large-star
   and small-star rounds, written to the shared folder between rounds.

Recall: a pair at similarity 0.8 shares no region with probability 3e-6, and falls
below 60 % agreement with probability under 1e-9; whatever is confirmed is exact.

Defined cases: texts without words and null texts have an empty set and link with
nothing; fewer words than a shingle make one shingle; very long texts are read whole;
repeated rows are copies; a null id counts as the largest, ids may have any type that
has an order; an empty table gives no rows; input columns named like results are
replaced, others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common
from strandloom.llm.substring import WordTable, rolling, scramble

TREES, DEPTH, LEAST = 24, 8, 4
PAIRS, NEAR, BLOCK, REGION = 512, 32, 3000, 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALTS = scramble(np.arange(1, 2 * TREES * DEPTH + 1)).astype(np.uint32).reshape(2, -1)


def shingles(text: str | None, size: int, known: WordTable) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = known.of(words)
    return np.unique(scramble(rolling(h, min(size, len(h))) + np.uint64(min(size, len(h)))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 16 bits each, of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    h = np.concatenate(sets).astype(np.uint32)
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for j in range(TREES * DEPTH):
        v = (h ^ _SALTS[0, j]) * (_SALTS[1, j] | np.uint32(1))
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, j] = np.minimum.reduceat(v, starts)
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(16)).astype(np.uint16)


def _describe(size):
    """(a, b, id, text) -> (a, b, id, n, class, signature)"""

    def run(batches):
        known = WordTable()
        for batch in batches:
            for start, stop in common.slices(batch.column(3), 4 << 20):
                part = batch.slice(start, stop - start)
                sets = [shingles(t, size, known) for t in part.column(3).to_pylist()]
                signed: list = [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                at = 0
                while at < len(full):  # pieces that fit the cache
                    end, n = at, 0
                    while end < len(full) and (end == at or n + len(sets[full[end]]) <= 1 << 16):
                        n += len(sets[full[end]])
                        end += 1
                    for i, row in zip(full[at:end], signatures([sets[i] for i in full[at:end]]), strict=True):
                        signed[i] = row.tobytes()
                    at = end
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())],
                    names=["a", "b", "id", "n", "class", "sig"])

    return run


def _branches(batches):
    """(class, sig) -> (tree, prefix of LEAST values, prefix of all, class)"""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
        words = np.ascontiguousarray(sig).view(np.int64).reshape(n, TREES, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(words[:, :, 0].ravel()), pa.array(words[:, :, 1].ravel()),
             batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))],
            names=["tree", "head", "tail", "class"])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def alike(sig: np.ndarray, least: float = 0.6) -> list[tuple[int, int]]:
    """A spanning forest of the candidate pairs of a region; rows of ``sig`` in tree order."""
    n, width = sig.shape
    need = int(least * width)
    forest, out = Forest(n), []

    def keep(i, js):
        for j in js.tolist():
            if forest.join(i, j):
                out.append((i, j))

    def whole(lo, hi):
        for i in range(lo, hi - 1):
            keep(i, i + 1 + np.flatnonzero((sig[i + 1 : hi] == sig[i]).sum(1) >= need))

    def descend(lo, hi, depth, order):
        if hi - lo <= PAIRS:
            whole(lo, hi)
        elif depth < DEPTH:
            cut = np.flatnonzero(order[lo + 1 : hi, depth] != order[lo : hi - 1, depth]) + lo + 1
            for x, y in zip([lo, *cut.tolist()], [*cut.tolist(), hi], strict=True):
                descend(x, y, depth + 1, order)
        else:  # no prefix splits it further: all its rows are candidates of its first one, and confirmed
            for i in range(lo + 1, hi):
                if forest.join(lo, i):
                    out.append((lo, i))

    descend(0, n, LEAST, sig[:, :DEPTH])
    if n > PAIRS:
        for step in range(1, NEAR + 1):
            for i in np.flatnonzero((sig[step:] == sig[:-step]).sum(1) >= need).tolist():
                if forest.join(i, i + step):
                    out.append((i, i + step))
    return out


def _region(table: pa.Table) -> pa.Table:
    tree = table.column("tree")[0].as_py()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
    sig = np.roll(sig, -tree * DEPTH, axis=1)
    order = np.lexsort(sig[:, DEPTH - 1 :: -1].T)
    ids = table.column("class").to_pylist()
    pairs = alike(np.ascontiguousarray(sig[order]))
    order = order.tolist()
    return pa.table({"u": pa.array([ids[order[i]] for i, _ in pairs], pa.binary()), "v": pa.array([ids[order[j]] for _, j in pairs], pa.binary())})


def links(sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, all pairs compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    value, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    keep = count[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    width = int(code.max()) + 1 if len(code) else 0
    forest, out = Forest(n), []
    if not width:
        return out
    bounds = np.searchsorted(owner, np.arange(n + 1))
    step = max(1, min(n, (8 << 20) // width))

    def dense(lo, hi, first, last):
        x = np.zeros((hi - lo, last - first), np.float32)
        a, b = bounds[lo], bounds[hi]
        inside = (code[a:b] >= first) & (code[a:b] < last)
        x[owner[a:b][inside] - lo, code[a:b][inside] - first] = 1
        return x

    wide = 8 << 20
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        for left in range(lo, n, step):
            end = min(n, left + step)
            common_ = sum(dense(lo, hi, c, min(width, c + wide)) @ dense(left, end, c, min(width, c + wide)).T for c in range(0, width, wide))
            union = size[lo:hi, None] + size[None, left:end] - common_
            for i, j in zip(*np.nonzero(100.0 * common_ >= percent * union), strict=True):
                i, j = int(i) + lo, int(j) + left
                if i < j and forest.join(i, j):
                    out.append((i, j))
    return out


def _confirm(percent):
    def run(table: pa.Table) -> pa.Table:
        sets = {}
        for k, s in zip(table.column("class").to_pylist(), table.column("set").to_pylist(), strict=True):
            sets.setdefault(k, s)
        ids = sorted(sets)
        found = links([np.frombuffer(sets[k], np.uint64) for k in ids], percent)
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.binary()), "v": pa.array([ids[j] for _, j in found], pa.binary())})

    return run


def _once(batches):
    """Drop rows that a task has seen before: equal rows meet the join once per task."""
    seen: set = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))


def _sets(size):
    def run(batches):
        known = WordTable()
        for batch in batches:
            for start, stop in common.slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                made = [shingles(t, size, known).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(made, pa.binary())], names=["class", "comp", "blocks", "set"])

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) pairs -> (node, root): root is the least node of the component.  Nodes without edges are not listed."""
    e = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # large-star
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))  # small-star
        last, e = e, common.written(small.where("u <> v").distinct(), "cc")
        common.forget(last)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _row_keys(ident, text):
    key, col = common.q(ident), common.q(text)
    return F.xxhash64(key, col), F.xxhash64(F.lit(7), col, key)


def classes_of(docs: DataFrame, *, text="text", ident="doc_id", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): of each row its keys a and b, id, number of shingles and class; of each class its root (the
    least class of its component) and its least row as ``rep`` (id is null, id, a, b)."""
    common.ship(docs.sparkSession)
    a, b = _row_keys(ident, text)
    rows = docs.select(a.alias("a"), b.alias("b"), common.q(ident).alias("id"), common.q(text).alias("t"))
    id_type = docs.schema[ident].dataType.simpleString()
    seen = common.written(rows.mapInArrow(_describe(size), f"a long, b long, id {id_type}, n long, class binary, sig binary"), "signed")
    some = seen.where("class is not null")
    rep = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "a", "b")).alias("rep")
    classes = common.written(some.groupBy("class").agg(rep, F.first("sig").alias("sig")), "classes")

    # 2: regions of two rows or more
    branch = classes.select("class", "sig").mapInArrow(_branches, "tree int, head long, tail long, class binary")
    region = branch.groupBy("tree", "head").agg(F.count("*").alias("rows"), F.min("class").alias("least")).where("rows > 1")
    inside = common.written(branch.join(region, ["tree", "head"]), "regions")
    hot = F.col("rows") > REGION
    deep = inside.where(hot).groupBy("tree", "head", "tail").agg(F.count("*").alias("deep"))
    split = inside.where(hot).join(deep, ["tree", "head", "tail"]).withColumn("salt", F.pmod(F.xxhash64("class"), F.ceil(F.col("deep") / REGION)))
    stars = split.select(F.col("class").alias("u"), F.col("least").alias("v"))
    plain = inside.where(~hot).select("tree", "head", F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("salt"), "class")
    placed = plain.unionByName(split.select("tree", "head", "tail", "salt", "class"))
    signed = placed.join(classes.select("class", "sig"), "class")
    edges = signed.groupBy("tree", "head", "tail", "salt").applyInArrow(_region, "u binary, v binary").unionByName(stars)
    candidate = components(edges)

    # 4: full sets of the candidates, in blocks
    blocks = candidate.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chosen = candidate.join(blocks, "root").join(classes.select("class", "rep.a", "rep.b"), F.col("node") == F.col("class")).select("class", "a", "b", F.col("root").alias("comp"), "blocks")
    texts = rows.select("a", "b", "t").mapInArrow(_once, "a long, b long, t string")
    full = texts.join(chosen, ["a", "b"]).select("class", "t", "comp", "blocks").mapInArrow(_sets(size), "class binary, comp binary, blocks int, set binary")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    full = full.withColumn("i", mine).withColumn("j", other)
    full = full.select("class", "comp", "set", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    linked = full.groupBy("comp", "i", "j").applyInArrow(_confirm(percent), "u binary, v binary")
    parts = components(linked)
    member = classes.select("class", "rep").join(parts, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "rep")
    member = common.written(member, "members")
    common.forget(inside, classes)
    return seen.drop("sig"), member


def near_duplicates(docs: DataFrame, *, text="text", ident="doc_id", keep=None, **options) -> DataFrame:
    """``docs`` with n_shingles, component_id (least id of the component) and kept (id = component_id)."""
    seen, member = classes_of(docs, text=text, ident=ident, **options)
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    # Classes that are alone, most of them, need no label: their component is their least row's.
    label = member.join(least, "root").select("class", F.col("least.id").alias("component"))
    out = common.others(docs.columns if keep is None else keep, ("n_shingles", "component_id", "kept"))
    # Rows without words are labelled before the join, so that they don't meet in one task.
    full, bare = seen.where("class is not null"), seen.where("class is null")
    described = full.join(label, "class").select("a", "b", "id", "n", "component").unionByName(bare.select("a", "b", "id", "n", F.col("id").alias("component")))
    results = [F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")]
    if set(out) <= {ident}:
        return described.select(*(F.col("id").alias(c) for c in out), *results)
    a, b = _row_keys(ident, text)
    rows = docs.select(*common.numbered(out), a.alias("a"), b.alias("b"))
    return rows.join(described.dropDuplicates(["a", "b"]), ["a", "b"]).select(*common.restored(out), *results)


def one_of_each(docs: DataFrame, *, text="text", ident="doc_id", **options) -> DataFrame:
    """The documents, columns as they came, with the least row of each component; documents without words stay."""
    _, member = classes_of(docs, text=text, ident=ident, **options)
    first = common.written(member.groupBy("root").agg(F.min("rep").alias("least")).select("least.a", "least.b"), "first")
    full = F.coalesce(common.q(text).rlike(common.WORD), F.lit(False))
    a, b = _row_keys(ident, text)
    chosen = docs.where(full).select(*common.numbered(docs.columns), a.alias("a"), b.alias("b")).join(first, ["a", "b"])
    # Equal rows are side by side after the join.
    chosen = chosen.dropDuplicates(["a", "b"]).select(*common.restored(docs.columns))
    return chosen.unionByName(docs.where(~full))
