"""Quality rules as a short-circuit cascade.

Cheap counts are taken of every document; then reject rules run in an order chosen
from a bounded sample: rejection rate per second first.  A document leaves the
cascade at the first rule that rejects it, so later rules cost nothing there.  The
verdict doesn't depend on the order, only the work does.

Defined cases: null and empty texts have zero counts and fail the base rules; very
long texts are read whole; repeated rows are judged alike; an empty table gives an
empty table; input columns that clash with result columns are replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common

_SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Doc:
    """A text with what the rules look at; each part is made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "replace")
        self.words = self.raw.split()
        self.n = len(self.words)
        self.word_chars = len(self.text) - (len(self.raw) - len(self.raw.translate(None, b" \t\n\r\x0b\x0c")))
        self.n_symbols = len(self.raw) - len(self.raw.translate(None, _SYMBOLS))
        lines = [x for x in self.text.split("\n") if x.strip(common.WHITE)]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated(self.words)


def repeated(words: list[bytes], k: int = 8) -> int:
    """Words that lie in a k-word window which the text has twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    w = h[:n].copy()
    for j in range(1, k):
        w *= _MIX
        w += h[j : j + n]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice)).tolist()
    count = Counter(tuple(words[i : i + k]) for i in at)  # words decide, not their hashes
    cover = np.zeros(len(words) + 1, np.int64)
    hit = [i for i in at if count[tuple(words[i : i + k])] > 1]
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.array(hit, np.int64) + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_failed(d: Doc) -> bool:
    return d.n < 20 or 100 * d.n_repeat_words > 30 * d.n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def _letters(d: Doc) -> bool:
    """Fewer than 7 of 10 words with an ASCII letter or a byte above 0x7F."""
    return 10 * sum(1 for w in d.words if not w.isascii() or w.lower() != w.upper()) < 7 * d.n


def _shouting(d: Doc) -> bool:
    """Over half of the words in capitals."""
    return 2 * sum(1 for w in d.raw.split() if len(t := w.decode("utf-8", "replace")) > 1 and t.isupper()) > d.n


def _top_word(d: Doc) -> bool:
    """One word makes up over 3 of 10."""
    return bool(d.n) and 10 * Counter(d.words).most_common(1)[0][1] > 3 * d.n


def _stutter(d: Doc) -> bool:
    """Over 1 of 5 words equals the word before it."""
    return 5 * sum(map(bytes.__eq__, d.words[1:], d.words)) > d.n


RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n or d.word_chars > 20 * d.n),
    Rule("dup_lines", lambda d: 2 * d.n_dup_lines > d.n_lines),
    Rule("exclamations", lambda d: 4 * d.raw.count(b"!") > d.n),
    Rule("letters", _letters),
    Rule("shouting", _shouting),
    Rule("top_word", _top_word),
    Rule("stutter", _stutter),
)


def plan(texts: list[str | None], rules=RULES) -> list[str]:
    """Rule names by rejections per second on ``texts``, each rule measured alone."""
    docs = [d for d in map(Doc, texts) if not base_failed(d)]
    rate = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, docs))
        rate[rule.name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-6)
    return sorted(rate, key=lambda r: -rate[r])


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("rejected_by", T.StringType()),
]


def assess(docs: DataFrame, *, text="text", rules=RULES, sample_rows: int = 1000, keep=None, order=None) -> DataFrame:
    """``docs`` with the counts, base_failed, kept and rejected_by.

    ``sample_rows`` bounds the sample, taken from one hash class in 64, that only
    orders the rules.
    """
    if order is None:
        picked = docs.select(common.q(text).alias("t")).where("t is not null and octet_length(t) < 100000")
        picked = picked.select(F.xxhash64("t").alias("h"), "t").where("pmod(h, 64) = 0").limit(sample_rows)
        order = plan([r.t for r in picked.collect()], rules)
    ranked = sorted(rules, key=lambda r: order.index(r.name))

    def fn(texts):
        rows = []
        for t in texts:
            d = Doc(t)
            failed = base_failed(d)
            by = "base" if failed else next((r.name for r in ranked if r.rejects(d)), None)
            rows.append((d.n, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, by is None, by))
        types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
        return [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]

    return common.text_map(docs, fn, FIELDS, text, keep)
