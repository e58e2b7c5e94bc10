"""Toxicity by compression distance.

Two zstandard dictionaries are made: one of words of ordinary text, by document
frequency, and one of words of toxic text that hold byte runs which toxic documents
have far more often.  Their content is chosen here, by label: the library's own trainer
picks what is frequent in toxic documents, which is mostly ordinary, and finds far less
(figures in the README).  A window is one word between spaces (long words are cut into
overlapping windows).  Between two fixed markers, which both dictionaries know, it is
compressed with either one; the pair of lengths, as what is saved against a window
without matches, is compared with thresholds calibrated per window size: the log likelihood ratio of toxic against ordinary documents with such
a pair.  A document's score is a logistic function of its three largest ratios.

Learning reads at most ``toxic_rows`` + ``ordinary_rows`` labelled documents, those of
lowest hash, on the driver; the thresholds are set on documents that the dictionaries
they meet haven't seen.  Scoring covers every window of every text in map tasks.

Defined cases: null and empty texts have no windows and get the score of no evidence;
very long texts are scored whole; repeated rows score alike; ids may have any type;
labels that are null are ignored, of contradicting ones the toxic counts; with under four labels of a kind every score is the share of toxic labels;
clashing columns are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEAD = bytes([*range(1, 9), *range(14, 30)])
#: A match can't begin in the last 8 bytes of a text, so a tail follows each window.
_TAIL = bytes([30, 31, 127, 1, 3, 5, 7, 2, 4, 6, 8, 14])
_LONG, _CUT, _STEP = 32, 24, 12
_TOP = 3
_NONE = -1.0


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a text."""
    out = set()
    for w in set(text.encode("utf-8", "replace").translate(_LOWER).split()) if text else ():
        w = b" " + w.strip(b".,!?;:\"'()") + b" "
        if len(w) <= _LONG:
            out.add(w)
        else:
            out.update(w[i : i + _CUT] for i in range(0, len(w) - _CUT + _STEP, _STEP))
    return out


def grams(window: bytes, n: int = 5) -> set[bytes]:
    return {window[i : i + n] for i in range(max(1, len(window) - n + 1))}


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    ratio: dict = field(default_factory=dict)  # (size, saved by ordinary, saved by toxic) -> log likelihood ratio
    weights: tuple = (0.0,) * (_TOP + 1)
    level: int = 6

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": None}

    def _open(self):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        made = [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d + _TAIL + _HEAD, dict_type=raw), **plain) for d in (self.ordinary, self.toxic)]
        # Lengths without any match, by window size: what a dictionary saves is counted from there.
        bare = [[len(m.compress(_HEAD + bytes(192 + (7 * i) % 64 for i in range(n)) + _TAIL)) for n in range(_LONG + 1)] for m in made]
        self._ready = made, bare, {}

    def cell(self, window: bytes):
        """Window size, and what either dictionary saves of it; None where the toxic one saves nothing."""
        if self._ready is None:
            self._open()
        (ordinary, toxic), bare, _ = self._ready
        text, size = _HEAD + window + _TAIL, len(window)
        saved = bare[1][size] - len(toxic.compress(text))
        if saved <= 0:
            return None
        return min(size, 20), bare[0][size] - len(ordinary.compress(text)), saved

    def evidence(self, text: str | None) -> list[float]:
        """The largest ratios of a text, in falling order."""
        if self._ready is None:
            self._open()
        cache = self._ready[2]
        if len(cache) > 400_000:
            cache.clear()
        for w in (seen := windows(text)):
            if w not in cache:
                cache[w] = self.ratio.get(self.cell(w), _NONE)
        return top(cache[w] for w in seen)

    def score(self, evidence) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def dictionaries(words, runs, n, *, toxic_bytes, ordinary_bytes, level) -> Model:
    """A model without thresholds, from document counts of windows and byte runs by label."""

    def often(count, other):
        return count / max(n[1], 1) > 8 * (other + 0.5) / max(n[0], 1)

    least = max(2, n[1] // 200)
    marked = {g for g, c in runs[1].items() if c >= least and often(c, runs[0][g])}
    special = sorted((c, w) for w, c in words[1].items() if c >= min(3, least) and often(c, words[0][w]) and grams(w) & marked)
    plain = heapq.nlargest(20000, ((c, w) for w, c in words[0].items()))[::-1]
    # Zeros in front make sizes equal: zstandard's search depends on them.
    parts = ((special, toxic_bytes), (plain, ordinary_bytes))
    return Model(*(b"".join(w for _, w in of)[-size:].rjust(size, b"\0") for of, size in parts), {}, level=level)


def fit(texts: list[str | None], labels: list[int], *, toxic_bytes=8192, ordinary_bytes=32768, level=6) -> Model:
    """Train the dictionaries; calibrate on documents that the dictionaries they meet haven't seen (two folds)."""
    n = [labels.count(0), labels.count(1)]
    if min(n) < 4:
        share = (n[1] + 0.5) / (sum(n) + 1)
        return Model(weights=(float(np.log(share / (1 - share))), *[0.0] * _TOP), level=level)
    options = {"toxic_bytes": toxic_bytes, "ordinary_bytes": ordinary_bytes, "level": level}
    met = [0, 0]
    folds = []
    for y in labels:
        folds.append(met[y] % 2)
        met[y] += 1
    words, runs = ([[Counter() for _ in range(2)] for _ in range(2)] for _ in range(2))
    for text, y, k in zip(texts, labels, folds, strict=True):
        seen = windows(text)
        words[k][y].update(seen)
        runs[k][y].update(set().union(*map(grams, seen)) if seen else ())
    size = [[sum(1 for a, b in zip(labels, folds, strict=True) if (a, b) == (y, k)) for y in range(2)] for k in range(2)]
    halves = [dictionaries(words[k], runs[k], size[k], **options) for k in range(2)]
    for y in range(2):
        words[0][y].update(words[1][y])
        runs[0][y].update(runs[1][y])
    model = dictionaries(words[0], runs[0], n, **options)
    del words, runs
    cells, each, memo = (Counter(), Counter()), [], ({}, {})
    for text, y, k in zip(texts, labels, folds, strict=True):
        half, known = halves[1 - k], memo[k]
        mine = {known[w] if w in known else known.setdefault(w, half.cell(w)) for w in windows(text)}
        each.append([c for w in windows(text) if (c := known[w]) is not None])
        cells[y].update(mine - {None})
    ratio = {k: float(np.log((c + 0.1) / (n[1] + 0.2)) - np.log((cells[0][k] + 0.1) / (n[0] + 0.2))) for k, c in cells[1].items()}
    x = np.array([[1.0, *top(ratio.get(c, _NONE) for c in cs)] for cs in each])
    model.ratio, model.weights = ratio, tuple(logistic(x, np.array(labels, float)).tolist())
    return model


def top(ratios) -> list[float]:
    return (heapq.nlargest(_TOP, (r for r in ratios if r > 0)) + [0.0] * _TOP)[:_TOP]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method, slopes held at 0 or above."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, text="text", ident="doc_id", label="toxic",
          toxic_rows: int = 2000, ordinary_rows: int = 6000, sample_bytes: int = 64 << 20) -> Model:
    """Learn from the labelled documents whose crc32(id as text) mod 3 is not 1.

    At most ``toxic_rows`` and ``ordinary_rows`` of them, those of lowest hash, each kind as
    long as its texts have no more than ``sample_bytes`` together; of rows with the same id the least text."""
    key = common.q(ident)
    known = labels.where(common.q(label).isin(0, 1) & key.isNotNull() & ~held_out(ident))
    known = known.groupBy(key.alias("id")).agg(F.max(common.q(label)).cast("int").alias("y")).withColumn("h", F.xxhash64("id"))
    texts = docs.select(key.alias("id"), common.q(text).alias("t")).where("id is not null")
    rows = []
    for y, most in ((1, toxic_rows), (0, ordinary_rows)):
        # At most most rows of an id and a number: a small broadcast.
        ids = F.broadcast(known.where(F.col("y") == y).orderBy("h", "id").limit(most))
        sizes = texts.join(ids, "id").groupBy("h", "id").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("n")).orderBy("h", "id").collect()
        total = np.cumsum([r.n for r in sizes])
        chosen = [(r.id,) for r, n in zip(sizes, total, strict=True) if n <= sample_bytes]
        chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[ident].dataType)])))
        rows += [(r.t, y) for r in texts.join(chosen, "id").groupBy("id").agg(F.min("t").alias("t")).orderBy(F.xxhash64("id"), "id").collect()]
    return fit([t for t, _ in rows], [y for _, y in rows])


def held_out(ident="doc_id"):
    return F.crc32(F.coalesce(common.q(ident).cast("string"), F.lit("")).cast("binary")) % 3 == 1


FIELDS = [T.StructField("score", T.DoubleType())]


def score(docs: DataFrame, model: Model, *, text="text", keep=None) -> DataFrame:
    """``docs`` with score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mine: list[Model] = []

    def fn(texts):
        if not mine:
            mine.append(shared.value)
        m = mine[0]
        return [pa.array([m.score(m.evidence(t)) for t in texts], pa.float64())]

    return common.text_map(docs, fn, FIELDS, text, keep)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text="text", ident="doc_id") -> DataFrame:
    """The documents, columns as they came, that score below ``threshold``."""
    model = train(docs, labels, text=text, ident=ident)
    inner, text, keep, back = common.guarded(docs, text, [f.name for f in FIELDS])
    return score(inner, model, text=text, keep=keep).where(F.col("score") < threshold).select(back)
