"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and test items are reduced to lower-cased words joined by one space.
Every run of ``window`` item words (or the whole item, if shorter) is a pattern
with a space on either side, so an occurrence always begins and ends at a word.
A block table tells, for the last few bytes under the search position, how far no
pattern can end; where it tells nothing, the block's bucket selects patterns by
their head and a direct comparison confirms them.

Each document is searched whole inside one map task: no shuffle, no candidate cap.
Items reach the tasks in blocks of at most ``block_bytes`` of item text; more items
mean more passes, never a larger broadcast.

Defined cases: null or word-free texts have no words and no hits; null or word-free
items never occur; equal item ids count once; items with a null id mark words but
are not listed; repeated document rows are judged alike; columns of the input that
clash with result columns are replaced.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common

#: Bytes of words are digits, a to z and all above 0x7F; A to Z become a to z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_MATCHERS: dict[str, list] = {}


def fold(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


def patterns(items, window: int) -> dict[bytes, set]:
    """Pattern -> ids of the items that have it."""
    found: dict[bytes, set] = {}
    for item, text in items:
        words = fold(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    return found


class WuManber:
    """Search for patterns whose lengths are alike (see ``tiers``)."""

    def __init__(self, found: dict[bytes, set]):
        self.least = m = min(map(len, found))
        # Blocks long enough that a random one is in few patterns.
        self.block = b = max(1, min(m // 2 + 1, m, math.ceil(math.log(2 * m * len(found), 8))))
        self.skip = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list]] = {}
        for p, items in found.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                if self.shift.get(block, self.skip) > m - end:
                    self.shift[block] = m - end
            self.bucket.setdefault(p[m - b : m], {}).setdefault(p[:m], []).append((p, items))

    def search(self, hay: bytes):
        """Yield (start, end, items) of every occurrence."""
        m, b, skip, shift, bucket = self.least, self.block, self.skip, self.shift.get, self.bucket
        i, n = m, len(hay)
        while i <= n:
            block = hay[i - b : i]
            step = shift(block, skip)
            if step:
                i += step
                continue
            for p, items in bucket[block].get(hay[i - m : i], ()):
                if hay.startswith(p, i - m):
                    yield i - m, i - m + len(p), items
            i += 1


def tiers(found: dict[bytes, set]) -> list[WuManber]:
    """One matcher for each class of lengths, so that short items don't shorten the shifts of long ones."""
    by: dict[int, dict] = {}
    for p, items in found.items():
        by.setdefault(min(len(p) // 8, 3), {})[p] = items
    return [WuManber(x) for _, x in sorted(by.items())]


def scan(text: str | None, matchers) -> tuple[int, list[tuple[int, int]], set]:
    """Words, merged word spans that are hit, ids of the items that occur."""
    words = fold(text)
    hay = b" " + b" ".join(words) + b" "
    spans, items = set(), set()
    for matcher in matchers:
        for start, end, of in matcher.search(hay) if words else ():
            spans.add((start, end))
            items |= of
    if not spans:
        return len(words), [], items
    at = np.flatnonzero(np.frombuffer(hay, np.uint8) == 32)
    pairs = np.array(sorted(spans))
    return len(words), merge(np.searchsorted(at, pairs[:, 0]).tolist(), np.searchsorted(at, pairs[:, 1] - 1).tolist()), items


def merge(starts, ends) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", _SPAN),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def contamination(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text",
                  window: int = 10, block_bytes: int = 4 << 20, keep=None) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word offsets, half-open) and hit_items (ids as strings, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(common.q(item_id).cast("string").alias("i"), common.q(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = common.others(docs.columns if keep is None else keep, (f.name for f in FIELDS))
    rows = docs.select(*common.numbered(out), common.q(text).alias("t"))
    for k in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()]
        rows = _pass(common.written(rows, "decontam") if k else rows, spark.sparkContext.broadcast(block), window, k > 0)
    return rows.select(*common.restored(out), *(f.name for f in FIELDS))


def _pass(rows, block, window, again):
    """Rows of in_..., t and, ``again``, earlier results: with the results so far."""
    key = uuid.uuid4().hex
    plain = [c for c in rows.columns if c not in {f.name for f in FIELDS}]
    common.ship(rows.sparkSession)
    schema = T.StructType([rows.schema[c] for c in plain] + FIELDS)

    def run(batches):
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = tiers(patterns(block.value, window))
        matchers = _MATCHERS[key]
        for batch in batches:
            for start, stop in common.slices(batch.column("t")):
                part = batch.slice(start, stop - start)
                rows = []
                before = (part.column("hit_spans").to_pylist(), part.column("hit_items").to_pylist()) if again else None
                for i, t in enumerate(part.column("t").to_pylist()):
                    n, spans, ids = scan(t, matchers)
                    ids = {x for x in ids if x is not None}
                    if before:
                        old = [(s["start"], s["end"]) for s in before[0][i]] + spans
                        spans, ids = merge([s for s, _ in old], [e for _, e in old]), ids | set(before[1][i])
                    rows.append((n, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(ids)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in plain] + [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                    names=plain + [f.name for f in FIELDS],
                )

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, columns as they came, in which no benchmark window occurs."""
    text = options.pop("text", "text")
    inner, text, keep, back = common.guarded(docs, text, [f.name for f in FIELDS])
    return contamination(inner, benchmark, text=text, keep=keep, **options).where("n_hit = 0").select(back)
