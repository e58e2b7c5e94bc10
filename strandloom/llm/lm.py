"""Language-model scores of whole documents.

1. Training documents (crc32 of the id as text, mod 5, not 1) are counted: every word
   and one end token per document.  The counts give the smoothed unigram base score.
2. A gated recurrent network with a class-factored softmax (``gru``) learns from every
   training document: in ``rounds``, each on another part of them, map tasks train
   from the current weights on what they hold, and their weights are averaged, by
   tokens, in groups of at most ``GROUP`` until one is left.  The most frequent words are
   symbols, ``SHORT`` at least and more as the vocabulary grows (``sizes``); all others
   belong to tails, by their last bytes, which are symbols too, and share one by their counts,
   so the model gives every word, and unknown ones, a probability.
3. Documents are scored whole, the state carried from window to window; the model works in
   single precision, so its part of a score has six decimals.

Counts of at most ``HEAD`` words are broadcast.  Words beyond meet their counts in a
join, so vocabularies of any size are exact.

Defined cases: null and empty texts have the end token only; a null id counts as the
empty text for the split; ids may have any type; very long texts are read whole, their
state carried on; repeated rows are documents of their own, equal ones score alike;
without training documents all counts are 0; input columns named like results are
replaced, others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import common, gru

END = b"\n"  # can't be a word
HEAD, SHORT, GROUP = 1 << 18, 1024, 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BATCH = 32 << 20  # bytes of text that the model takes at a time
_PART = 16 << 20  # and of those, that are split into words at a time
_HELD = 64 << 20  # bytes of weights that meet in a reducer


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def tokenised(column) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end (binary, ASCII letters lower), and how many each text has; as ``words`` finds them."""
    texts = column.fill_null("")
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    flat = lists.flatten().cast(pa.binary())
    full = np.asarray(pa.compute.greater(pa.compute.binary_length(flat), 0))
    edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    sizes = np.diff(edges).astype(np.int64)
    if not full.all():  # around the text's first and last word
        sizes -= np.bincount(np.searchsorted(edges, np.flatnonzero(~full), side="right") - 1, minlength=len(texts))
        flat = flat.filter(pa.array(full))
    return flat, sizes


def _pieces(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls, cut from its buffer."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def tail_of(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def sizes(distinct: int, head: int) -> tuple[int, int]:
    """Symbols and tails of a vocabulary: four times its root, and at least the root of the symbols.

    Symbols come in multiples of the tails; a vocabulary too small for one leaves places empty."""
    symbols = min(max(SHORT, 4 * math.isqrt(distinct)), head)
    tails = gru.CLASS
    while tails * tails < symbols:
        tails *= 2
    return max(1, symbols // tails) * tails, tails


def held_out(ident: str):
    return F.crc32(F.coalesce(common.q(ident).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _count(batches):
    """Counts by chunk; Spark's partial sums join them."""
    for chunk in _chunks(batches):
        flat, _ = tokenised(chunk.column(0))
        count = flat.value_counts()
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([count.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([count.field("counts"), pa.array([chunk.num_rows], pa.int64())])],
                                         names=["word", "c"])


def _tails(skip, tails):
    """Of (word, c): words and counts by tail class, without the words in ``skip``."""

    def run(batches):
        total, kinds = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in skip.value:
                    k = tail_of(w, tails)
                    total[k] += c
                    kinds[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(tails), pa.int32()), pa.array(total), pa.array(kinds)], names=["tail", "c", "n"])

    return run


class Vocabulary:
    """The most frequent words with their counts; the first ones are symbols of the model."""

    def __init__(self, head: list[tuple[bytes, int]], symbols: int, total: int, distinct: int, tails):
        self.words, self.counts = [w for w, _ in head], np.array([c for _, c in head], np.int64)
        self.symbols, self.total, self.distinct = symbols, total, distinct
        self.tail_total, self.tail_kinds = tails
        self.tails = len(self.tail_total)
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"words": b"\0".join(self.words), "table": None}

    def __setstate__(self, state):
        self.__dict__ = state | {"words": state["words"].split(b"\0") if state["words"] else []}

    def open(self):
        if self.table is None:
            self.table = _Numbers(((w, i) for i, w in enumerate(self.words)), tails=self.tails)
            # Symbols by number; those of tail classes from the end, so that -1 - class finds them.
            head = [i if i < self.symbols else self.symbols + tail_of(w, self.tails) for i, w in enumerate(self.words)]
            self.symbol = np.array([*head, *(self.symbols + t for t in range(self.tails - 1, -1, -1))], np.int32)
        return self

    @property
    def end(self) -> int:
        """The end token's symbol."""
        return int(self.symbol[self.open().table[END]])

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Head numbers; -1 - tail class for other words."""
        return np.fromiter(map(self.table.__getitem__, tokens), np.int32, len(tokens))

    def model_symbols(self, ids) -> np.ndarray:
        return self.symbol[ids]

    def read(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of all texts end to end, each closed by the end token: ids of the tokens, their places in the
        dictionary, tokens of each text, and the dictionary.  Each distinct word is looked up once."""
        flat, sizes = tokenised(column)
        coded = flat.dictionary_encode()
        del flat  # the words' bytes; from here on tokens are numbers
        dictionary = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        known = self.ids(_pieces(dictionary))
        sizes = sizes + 1
        place = np.full(int(sizes.sum()), len(dictionary) - 1, np.int32)
        word = np.ones(len(place), bool)
        word[np.cumsum(sizes) - 1] = False
        place[word] = np.asarray(coded.indices)
        return known[place], place, sizes, dictionary


class _Numbers(dict):
    def __init__(self, items, tails: int):
        super().__init__(items)
        self.tails = tails

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-3:]) % self.tails


def _chunks(batches, column=0):
    for batch in batches:
        for start, stop in common.slices(batch.column(column), _BATCH):
            yield batch.slice(start, stop - start)


def _parts(column):
    """The texts of a chunk bit by bit: the model takes a chunk's tokens as numbers, but their words never lie open all at once."""
    for start, stop in common.slices(column, _PART):
        yield column.slice(start, stop - start)


def _train(vocabulary, weights):
    """One task's weights after its documents: (group, tokens, weights * tokens)."""

    def run(batches):
        v = vocabulary.value.open()
        trainer = gru.Trainer({k: x.copy() for k, x in weights.value.items()})
        seen = 0
        for chunk in _chunks(batches):
            docs = []
            for texts in _parts(chunk.column(0)):
                ids, _, sizes, _ = v.read(texts)
                seen += len(ids)
                docs += np.split(v.model_symbols(ids), np.cumsum(sizes)[:-1])
            trainer.learn(docs, v.end)
        if seen:
            yield _weights([(TaskContext.get().partitionId(), seen, gru.flat(trainer.p).astype(np.float64) * seen)])

    return run


def _weights(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary())],
                                      names=["k", "n", "w"])


def _sum(group):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py(), "<f4").astype(np.float64) for w in table.column("w"))
        k = table.column("k")[0].as_py() // group
        return pa.Table.from_batches([_weights([(k, sum(table.column("n").to_pylist()), total)])])

    return run


_SCHEMA = "k long, n long, w binary"


def averaged(parts: DataFrame, tasks: int, like):
    """Of the written table ``parts``, which goes: the token-weighted mean of the tasks' weights; a reducer holds ``GROUP`` of them at most, fewer if they are large."""
    group = max(2, min(GROUP, _HELD // (4 * sum(x.size for x in like.values()))))
    while tasks > 1:  # the driver receives one row
        last, parts = parts, common.written(parts.groupBy(F.expr(f"k div {group}")).applyInArrow(_sum(group), _SCHEMA), "weights")
        common.forget(last)
        tasks = -(-tasks // group)
    rows = parts.collect()
    common.forget(parts)
    n = sum(r.n for r in rows)
    return gru.shaped(sum(np.frombuffer(r.w, "<f4").astype(np.float64) for r in rows) / n, like) if n else like


def _score(vocabulary, weights):
    """(held_out..., text) -> a row per document, with the words that the head doesn't have."""

    def counted(v, texts, logs, share):
        """Each text's symbols, and by text: tokens, those in the head, their base score, what tails add, other words and how often."""
        ids, place, sizes, dictionary = v.read(texts)
        n = len(sizes)
        symbols, doc = v.model_symbols(ids), np.repeat(np.arange(n, dtype=np.int32), sizes)
        known, tail = ids >= 0, symbols >= v.symbols
        base = np.bincount(doc[known], logs[ids[known]], n).astype(np.float64)
        inner = known & tail
        spread = np.bincount(doc[inner], logs[ids[inner]], n) - np.bincount(doc[tail], share[symbols[tail] - v.symbols], n)
        # Words beyond the head, each once for a document.
        rest, times = np.unique(doc[~known].astype(np.int64) * len(dictionary) + place[~known], return_counts=True)
        offsets = pa.array(np.searchsorted(rest, np.arange(n + 1, dtype=np.int64) * len(dictionary)), pa.int32())
        other = pa.ListArray.from_arrays(offsets, dictionary.take(pa.array(rest % len(dictionary))))
        return (np.split(symbols, np.cumsum(sizes)[:-1]),
                (sizes, np.bincount(doc[known], minlength=n).astype(np.int64), base, spread, other, pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))))

    def run(batches):
        v = vocabulary.value.open()
        logs = np.log10(v.counts + 0.5)
        share = np.log10(v.tail_total + 0.5 * (v.tail_kinds + 1))
        part, k = TaskContext.get().partitionId(), 0
        for chunk in _chunks(batches):
            docs, rows, at = [], [], 0
            for texts in _parts(chunk.column(0)):
                symbols, made = counted(v, texts, logs, share)
                docs += symbols
                rows.append(made)
            model = gru.log_likelihood(weights.value, docs, v.end) / math.log(10)
            del docs
            for sizes, known, base, spread, other, times in rows:
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(i).slice(at, n) for i in range(1, chunk.num_columns)]
                    + [pa.array(np.arange(k, k + n)), pa.array([part] * n, pa.int32()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(np.round(spread + model[at : at + n], 6)), other, times],
                    names=[*chunk.schema.names[1:], "__k", "__part", "n_tokens", "__known", "__base", "__model", "__words", "__times"])
                k, at = k + n, at + n

    return run


def vocabulary(counts: DataFrame) -> Vocabulary:
    spark = counts.sparkSession
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    # How many words have each count decides which counts make the head.
    levels, least, have = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")), None, 0
    for r in levels.collect():
        if have + r.n > HEAD:
            break
        have, least = have + r.n, r.c
    head = [(bytes(r[0]), r[1]) for r in counts.where(F.col("c") >= least).collect()] if least is not None else []
    head.sort(key=lambda x: (-x[1], x[0]))
    if END in (w for w, _ in head):
        end = next(x for x in head if x[0] == END)
        head.remove(end)
        head.insert(0, end)
    symbols, width = sizes(totals[1], len(head))
    skip = spark.sparkContext.broadcast({w for w, _ in head[:symbols]})
    tails = counts.select("word", "c").mapInArrow(_tails(skip, width), "tail int, c long, n long").groupBy("tail").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).orderBy("tail").collect()
    by = {r.tail: (r.c, r.n) for r in tails}
    return Vocabulary(head, symbols, totals[0] or 0, totals[1], (np.array([by.get(t, (0, 0))[0] for t in range(width)]), np.array([by.get(t, (0, 0))[1] for t in range(width)])))


def score(docs: DataFrame, *, text="text", ident="doc_id", rounds: int = 2, keep=None) -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    common.ship(spark)
    col = common.q(text)
    training = docs.where(~held_out(ident))
    counts = training.select(col.alias("t")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = common.written(counts, "counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    counted = np.zeros(v.symbols)
    counted[: len(v.counts)] = v.counts[: v.symbols]
    weights = gru.initial(counted, v.tail_total.astype(float))
    for r in range(rounds):
        mine = training.where(F.pmod(F.xxhash64(col, common.q(ident)), F.lit(rounds)) == r).select(col.alias("t"))
        parts = mine.mapInArrow(_train(shared, spark.sparkContext.broadcast(weights)), _SCHEMA)
        parts = common.written(parts, "weights")
        weights = averaged(parts, (parts.agg(F.max("k")).first()[0] or 0) + 1, weights)
    out = common.others(docs.columns if keep is None else keep, ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    rows = docs.select(col.alias("__text"), *common.numbered(out), held_out(ident).alias("held_out"))
    made = T.StructType.fromDDL("__k long, __part int, n_tokens long, __known long, __base double, __model double, __words array<binary>, __times array<long>")
    schema = T.StructType(rows.schema.fields[1:] + made.fields)
    done = common.written(rows.mapInArrow(_score(shared, spark.sparkContext.broadcast(weights)), schema), "scored")
    rest = done.select("__part", "__k", F.explode(F.arrays_zip(F.col("__words").alias("w"), F.col("__times").alias("n"))).alias("x")).select("__part", "__k", F.col("x.w").alias("word"), F.col("x.n").alias("n"))
    met = rest.join(counts, "word", "left").groupBy("__part", "__k").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("__rest_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("__rest_sum"))
    rest_known, rest_sum = F.coalesce("__rest_known", F.lit(0)), F.coalesce("__rest_sum", F.lit(0.0))
    each = math.log10(v.total + 0.5 * (v.distinct + 1))
    return done.drop("__words", "__times").join(met, ["__part", "__k"], "left").select(
        *common.restored(out), "held_out", "n_tokens", (F.col("__known") + rest_known).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("__base") + rest_sum - F.col("n_tokens") * each).alias("base_score"),
        (F.col("__model") + rest_sum).alias("score"))
