"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the
smallest hash among its runs of ``seed`` words, the leftmost of equals, so consecutive
windows mostly share one; the windows around one occurrence of it are a super-k-mer.

1. Minimisers are counted: a window whose minimiser occurs once in the corpus can't
   be repeated, so most super-k-mers end here, as a few bytes each.
2. The others are packed, each as one string of words, and sent to their minimiser's
   bucket.  Equal windows have equal minimisers, so they meet there; the bucket sorts
   its windows and compares their words, which counts them exactly.
3. Words under repeated windows are cut from each document.

A map batch folds equal strings: one goes out, marked as repeated.  So a passage in a third of all documents reaches its bucket once per map batch.  Around
a minimiser that occurs over ``crowded`` times, where strings differ in the words next
to a very common passage, windows travel as 128-bit fingerprints dealt by fingerprint,
so that no bucket has to hold them all.  Rows with the same id and text are counted by
their keys: every window of theirs is repeated, so one of them goes out for all.

Defined cases: null and empty texts have no words and keep none; documents shorter
than a window lose nothing; very long texts are read whole; repeated rows are each
other's copies, and lose every word if they have a window at all; ids may have any type
or be null; an empty table gives no rows; input columns named like results are
replaced, others may have any name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_NEVER = np.uint64(2**64 - 1)


class WordTable(dict):
    """Words -> hashes that are the same in every process, looked up in bulk."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.hashes, self.new = most, np.zeros(0, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(xxhash.xxh3_64_intdigest(word))
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.hashes, self.new = np.zeros(0, np.uint64), []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array(self.new, np.uint64)])
            self.new = []
        return self.hashes[at]


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    h = h.astype(np.uint64)
    for m in _MUL:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out *= _ODD
        out += h[j : j + n]
    return out


def sliding_min(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each run of w, and its leftmost place, by doubling."""
    place, have = np.arange(len(x), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        right = x[step:] < x[:-step]
        place = np.where(right, place[step:], place[:-step])
        x = np.where(right, x[step:], x[:-step])
        have += step
    return x, place


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, window: int, seed: int):
    """(document, first window in it, number of windows, minimiser) of every super-k-mer of documents laid end to end."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    least, where = sliding_min(scramble(rolling(hashes, seed)), window - seed + 1)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    place = np.arange(len(least)) - begin[owner]
    valid = place + window <= sizes[owner]
    new = np.ones(len(least), bool)
    new[1:] = (where[1:] != where[:-1]) | (place[1:] == 0) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    run = np.cumsum(new) - 1
    count = np.bincount(run[valid], minlength=run[-1] + 1)[run[first]]
    return owner[first], place[first], count, least[first].view(np.int64)


def tokens(column) -> list[list[bytes]]:
    return [t.encode("utf-8", "replace").split() if t else [] for t in column.to_pylist()]


def _columns(rows, types):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]


_PACKED = "bucket int, a long, b long, data binary, meta binary"
_PACKED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = ["bucket", "a", "b", "data", "meta"]


def _by_document(a, b, values):
    """Rows of int64 ``values`` grouped by their document: (a, b, data); of equal first values in one, which copies of a row give, one."""
    order = np.lexsort((values[:, 0], b, a))
    a, b, values = a[order], b[order], values[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (values[1:, 0] != values[:-1, 0])
    if not new.all():
        a, b, values = a[new], b[new], values[new]
    for i, j in zip(*_runs(a, b), strict=True):
        yield int(a[i]), int(b[i]), values[i:j].tobytes()


def _survey(window, seed, buckets):
    """Send minimisers to their buckets: those met once in the batch with their place, others with their number.

    Places of the latter are repeated for certain; they go on as rows of their document."""

    def run(batches):
        table = WordTable()
        for batch in batches:
            for start, stop in common.slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                docs = tokens(part.column(2))
                sizes = np.array([len(d) for d in docs], np.int64)
                hashes = table.of([w for d in docs for w in d])
                doc, first, count, least = super_kmers(hashes, sizes, window, seed)
                if not len(doc):
                    continue
                a, b = (part.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
                _, one, inverse, times = np.unique(least, return_index=True, return_inverse=True, return_counts=True)
                often = times[inverse] > 1
                rows = [(x % buckets, x, y, d, None) for x, y, d in _by_document(a[often], b[often], np.stack([first, count, least], 1)[often])]
                lines = np.stack([least, a, b, first, count], 1)[one]
                lines[times > 1, 3] = -1
                lines = np.concatenate([lines, times[:, None]], 1)
                to = (lines[:, 0].copy().view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, lines = to[order], lines[order]
                for i, j in zip(*_runs(to), strict=True):
                    rows.append((int(to[i]), None, None, pack(lines[i:j].T.astype("<i8", order="C").tobytes()), None))
                yield pa.RecordBatch.from_arrays(_columns(rows, _PACKED_TYPES), names=_NAMES)

    return run


def _runs(*keys):
    """Bounds of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return [], []
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    edge = np.flatnonzero(new).tolist()
    return edge, [*edge[1:], n]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _common(crowded):
    """Of one bucket: the places whose minimiser occurs twice or more, by document, as (first, count, minimiser);
    and, without a document, the minimisers that occur over ``crowded`` times."""

    def run(table: pa.Table) -> pa.Table:
        rows, parts = [], [np.zeros((6, 0), np.int64)]
        for a, b, data in zip(*(table.column(c).to_pylist() for c in ("a", "b", "data")), strict=True):
            if a is None:
                parts.append(np.frombuffer(unpack(data), np.int64).reshape(6, -1))
            else:
                rows.append((a, b, data))
        least, a, b, first, count, times = np.concatenate(parts, 1)
        value, inverse = np.unique(least, return_inverse=True)
        total = np.zeros(len(value), np.int64)
        np.add.at(total, inverse, times)
        live = (total[inverse] > 1) & (first >= 0)
        rows = list(dict.fromkeys(rows))
        if live.any():
            rows += _by_document(a[live], b[live], np.stack([first, count, least], 1)[live])
        if (total > crowded).any():
            rows.append((None, None, value[total > crowded].tobytes()))
        return pa.table(dict(zip(("a", "b", "data"), _columns(rows, [pa.int64(), pa.int64(), pa.binary()]), strict=True)))

    return run


def _pack_strings(window, buckets, crowded):
    """(a, b, text, copies, places) -> packed strings and fingerprints by bucket; spans known to be repeated by document."""

    def run(batches):
        table, often, copied = WordTable(), crowded.value, set()
        for batch in batches:
            for start, stop in common.slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                seen: dict[bytes, list] = {}
                twice: dict[tuple, list] = defaultdict(list)
                prints = []
                a_, b_, n_ = (part.column(i).to_pylist() for i in (0, 1, 3))
                fresh = [i for i, key in enumerate(zip(a_, b_, strict=True)) if n_[i] is None or key not in copied]
                copied.update((a_[i], b_[i]) for i in fresh if n_[i] is not None)
                if len(copied) > 1_000_000:  # at worst a copy goes out again, which changes nothing
                    copied.clear()
                part = part.take(pa.array(fresh, pa.int64()))
                sent = set()
                for i, words, places in zip(fresh, tokens(part.column(2)), part.column(4).to_pylist(), strict=True):
                    a, b, many = a_[i], b_[i], n_[i] is not None
                    if many and (a, b) in sent:
                        continue
                    if many:
                        sent.add((a, b))
                    places = np.unique(np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 3) for p in places]), axis=0)
                    hot = _among(places[:, 2], often).tolist()
                    for (first, count, least), crowd in zip(places.tolist(), hot, strict=True):
                        inside = words[first : first + count + window - 1]
                        if many:  # its copies have the same windows
                            twice[a, b].append((first, first + count))
                        if crowd:
                            prints += [(a, b, first, fingerprints(table.of(inside), window))] * (1 + many)
                            continue
                        string = b" ".join(inside)
                        got = seen.get(string)
                        if got is None:
                            seen[string] = [least, a, b, first, count, *([True] if many else [])]
                            continue
                        if len(got) == 5:
                            twice[got[1], got[2]].append((got[3], got[3] + got[4]))
                            got.append(True)
                        twice[a, b].append((first, first + count))
                by: dict[int, list] = defaultdict(list)
                for string, got in seen.items():
                    by[(got[0] % 2**64) % buckets].append((string, (got[1], got[2], got[3], len(got) == 6)))
                rows = [(k, None, None, pack(b"\n".join(s for s, _ in v)), np.array([m for _, m in v], np.int64).tobytes()) for k, v in by.items()]
                rows += [(a % buckets, a, b, np.array(v, np.int64).tobytes(), None) for (a, b), v in twice.items()]
                rows += _deal(prints, buckets)
                yield pa.RecordBatch.from_arrays(_columns(rows, _PACKED_TYPES), names=_NAMES)

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """128 bits for each window."""
    return np.stack([scramble(rolling(hashes, window)), scramble(rolling(scramble(hashes + _ODD), window))], 1)


def _deal(prints, buckets):
    """Fingerprint rows by bucket, (bucket, -1, null, fingerprints, places)."""
    if not prints:
        return []
    f = np.concatenate([p for *_, p in prints])
    lines = np.concatenate([np.stack([np.full(len(p), a), np.full(len(p), b), np.arange(first, first + len(p))], 1) for a, b, first, p in prints])
    to = (f[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to, f, lines = to[order], f[order], lines[order]
    return [(int(to[i]), -1, None, f[i:j].tobytes(), pack(lines[i:j].tobytes())) for i, j in zip(*_runs(to), strict=True)]


def repeated_windows(strings: list[bytes], marks: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each string the runs of its windows that occur more than once in all (a marked string counts twice)."""
    words = [s.split(b" ") for s in strings]
    sizes = np.array([len(w) for w in words])
    ids = WordTable()
    code = np.fromiter((x for w in words for x in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
    windows = sizes - window + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = place + begin[owner]
    h = scramble(rolling(scramble(code + 1), window))[at]
    order = np.argsort(h)
    s = h[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([edge, [len(s)]]))
    many = np.repeat(size > 1, size)
    hit = marks[owner] > 0
    chosen = order[many]
    head = order[np.repeat(edge[size > 1], size[size > 1])]
    same = all((code[at[chosen[i : i + 65536], None] + np.arange(window)] == code[at[head[i : i + 65536], None] + np.arange(window)]).all() for i in range(0, len(chosen), 65536))
    if same:  # words decide, not hashes
        hit[chosen] = True
    else:  # different windows share a hash: sort their words
        _, inverse, count = np.unique(code[at[chosen, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
        hit[chosen[count[inverse.ravel()] > 1]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    at_hit = np.flatnonzero(hit)
    if len(at_hit):
        gap = np.flatnonzero((np.diff(at_hit) != 1) | (np.diff(owner[at_hit]) != 0)) + 1
        for i, j in zip(at_hit[np.concatenate([[0], gap])].tolist(), at_hit[np.concatenate([gap, [len(at_hit)]]) - 1].tolist(), strict=True):
            out[owner[i]].append((int(place[i]), int(place[j]) + 1))
    return out


def _count(window):
    """Count the windows of one bucket; spans known already pass."""

    def run(table: pa.Table) -> pa.Table:
        strings: list[bytes] = []
        metas = [np.zeros((0, 4), np.int64)]
        done, prints, lines = [], [], []
        for a, b, data, meta in zip(*(table.column(c).to_pylist() for c in ("a", "b", "data", "meta")), strict=True):
            if meta is None:
                done.append((a, b, data))
            elif a is None:
                strings += unpack(data).split(b"\n")
                metas.append(np.frombuffer(meta, np.int64).reshape(-1, 4))
            else:
                prints.append(np.frombuffer(data, np.uint64).reshape(-1, 2))
                lines.append(np.frombuffer(unpack(meta), np.int64).reshape(-1, 3))
        meta = np.concatenate(metas)
        found: dict[tuple, list] = defaultdict(list)
        if strings:
            for (a, b, first, marked), runs in zip(meta.tolist(), repeated_windows(strings, meta[:, 3], window), strict=True):
                if runs and not marked:
                    found[a, b] += [(first + x, first + y) for x, y in runs]
        done += [(a, b, np.array(v, np.int64).tobytes()) for (a, b), v in found.items()]
        if prints:
            f, line = np.concatenate(prints), np.concatenate(lines)
            _, inverse, count = np.unique(f, axis=0, return_inverse=True, return_counts=True)
            line = line[count[inverse.ravel()] > 1]
            done += _by_document(line[:, 0], line[:, 1], np.stack([line[:, 2], line[:, 2] + 1], 1))
        return pa.table(dict(zip(("a", "b", "data"), _columns(done, [pa.int64(), pa.int64(), pa.binary()]), strict=True)))

    return run


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
]


def deduplicate(docs: DataFrame, *, text="text", ident="doc_id", window: int = 35, seed: int = 8,
                bucket_bytes: int = 8 << 20, crowded: int = 200_000, keep=None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words outside every repeated window, joined by one space)."""
    common.ship(docs.sparkSession)
    col = common.q(text)
    a, b = F.xxhash64(common.q(ident), col), F.xxhash64(F.lit(7), col, common.q(ident))
    rows = docs.select(a.alias("a"), b.alias("b"), col.alias("t"))
    size = docs.agg(F.sum(F.octet_length(col))).first()[0] or 0
    buckets = max(1, min(1 << 24, size // bucket_bytes))
    copies = common.written(rows.where("t is not null").groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    survey = rows.mapInArrow(_survey(window, seed, buckets), _PACKED)
    # The same up to 100 TB; beyond, so that at most some 2**29 / 100 minimisers (of size / 100 super-k-mers) are broadcast.
    crowded = max(crowded, size >> 29)
    places = survey.groupBy("bucket").applyInArrow(_common(crowded), "a long, b long, data binary")
    places = common.written(places.groupBy("a", "b").agg(F.collect_list("data").alias("places")), "places")
    often = [np.frombuffer(p, np.int64) for r in places.where("a is null").select(F.explode("places")).collect() for p in r]
    often = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.int64), *often])))
    met = rows.join(places.where("a is not null").join(copies, ["a", "b"], "left"), ["a", "b"])
    sent = met.select("a", "b", "t", "copies", "places").mapInArrow(_pack_strings(window, buckets, often), _PACKED)
    spans = sent.groupBy("bucket").applyInArrow(_count(window), "a long, b long, data binary")
    spans = common.written(spans.groupBy("a", "b").agg(F.collect_list("data").alias("spans")), "spans")
    common.forget(places, copies)
    out = common.others(docs.columns if keep is None else keep, (f.name for f in FIELDS))
    full = docs.select(*common.numbered(out), col.alias("t"), a.alias("a"), b.alias("b"))
    joined = full.join(spans, ["a", "b"], "left").select(*(f"in_{i}" for i in range(len(out))), "t", "spans")
    schema = T.StructType(common.numbered_fields(docs.schema, out) + FIELDS)

    def cut(batches):
        for batch in batches:
            for start, stop in common.slices(batch.column("t")):
                part = batch.slice(start, stop - start)
                done = [_cut(w, s, window) for w, s in zip(tokens(part.column("t")), part.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:-2] + _columns(done, [pa.int64(), pa.int64(), pa.string()]), names=schema.names)

    return joined.mapInArrow(cut, schema).select(*common.restored(out), *(f.name for f in FIELDS))


def _cut(words, spans, window):
    if not spans:
        return len(words), 0, b" ".join(words).decode("utf-8", "replace")
    gone = np.zeros(len(words) + 1, np.int64)
    pairs = np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans])
    np.add.at(gone, pairs[:, 0], 1)
    np.add.at(gone, pairs[:, 1] + window - 1, -1)
    kept = [w for w, k in zip(words, (np.cumsum(gone)[:-1] == 0).tolist(), strict=True) if k]
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
