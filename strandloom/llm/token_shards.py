"""Token sequences in training order, as binary shards of fixed stride.

1. Map tasks tokenise documents, close each with an end token, pack the tokens of a
   partition into sequences of ``length`` and write them, compressed by columns, to the shared
   folder.  Tokens are made once; what later steps see doesn't depend on how the
   input would be split another time.
2. Sequences are numbered by part and place, and a keyed Feistel permutation with
   cycle-walking gives each number its slot in the training order.
3. Sequences travel to their shard, a range of slots; a shard is one file in which
   slot s begins at (s - first) * length * width bytes.  A file appears whole, under a
   name that depends on nothing but its shard, so a repeated task is harmless.

``read_slots`` reads any run of slots by seeking, so training can stop and resume.

Defined cases: null and empty texts give no tokens; documents longer than a sequence
continue in the next; the last sequence of a part is padded with the end token and
says how many tokens it holds; repeated rows are documents of their own; integer ids are
listed as they are, others as text, null ones as null; other columns are ignored; very
long texts are tokenised whole; an empty table writes no shard.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common, files
from strandloom.llm.permute import permuted

# Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the registered query finds its vocabulary; an option everywhere else.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_OPEN: dict[str, object] = {}


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs, length: int, end: int, kind: str):
    """(id, tokens) of documents -> (tokens held, sequence, [(id, start)]) of full sequences; the last one is padded."""
    buffer, owners = array(kind), []
    for ident, tokens in docs:
        begin = 0
        owners.append((ident, len(buffer)))
        buffer.extend(tokens)
        buffer.append(end)
        while len(buffer) - begin >= length:
            yield length, buffer[begin : begin + length], [(d, max(0, s - begin)) for d, s in owners]
            begin += length
            owners = owners[-1:] if len(buffer) > begin else []
        if begin:
            buffer = buffer[begin:]
            owners = [(d, max(0, s - begin)) for d, s in owners]
    if buffer:
        n = len(buffer)
        buffer.extend([end] * (length - n))
        yield n, buffer, owners


def _tokenise(shared, length, end, kind, kept):
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = encoder(shared.value)
        encode = _OPEN[key].encode_ordinary
        part = TaskContext.get().partitionId()

        def docs():
            for batch in batches:
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        yield ident, encode(text)

        rows, k = [], 0
        for n, tokens, owners in pack(docs(), length, end, kind):
            rows.append((part, k, n, [d for d, _ in owners], [s for _, s in owners], tokens.tobytes()))
            k += 1
            if len(rows) == 1024:
                yield _sequences(rows, kept)
                rows = []
        if rows:
            yield _sequences(rows, kept)

    return run


_SCHEMA = "part int, k long, n_tokens int, doc_ids array<{}>, starts array<int>, data binary"


def _id(kept):
    return pa.int64() if kept == "long" else pa.string()


def _sequences(rows, kept):
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(_id(kept)), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["part", "k", "n_tokens", "doc_ids", "starts", "data"])


_PACKED = "shard int, slots array<long>, n_tokens array<int>, doc_ids array<array<{}>>, starts array<array<int>>, data binary"


def _shrink(batches, kept):
    """Sequences of a batch that go to the same shard travel together, compressed."""
    shrink = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        shard, slot, n, ids, starts, data = (batch.column(c).to_pylist() for c in ("shard", "slot", "n_tokens", "doc_ids", "starts", "data"))
        by: dict[int, list[int]] = {}
        for i, k in enumerate(shard):
            by.setdefault(k, []).append(i)
        rows = [(k, *([v[i] for i in at] for v in (slot, n, ids, starts)), shrink(b"".join(data[i] for i in at))) for k, at in by.items()]
        types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(_id(kept))), pa.list_(pa.list_(pa.int32())), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "slots", "n_tokens", "doc_ids", "starts", "data"])


def _write(out, width, length, per_shard, kept):
    stride = length * width

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        first, rows = shard * per_shard, []
        for slots, n, ids, starts, data in zip(*(table.column(c).to_pylist() for c in ("slots", "n_tokens", "doc_ids", "starts", "data")), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(data)
            rows += [(*x, raw[i * stride : (i + 1) * stride]) for i, x in enumerate(zip(slots, n, ids, starts, strict=True))]
        rows.sort(key=lambda r: r[0])
        slots = [r[0] for r in rows]
        if slots != list(range(first, first + len(slots))):
            raise RuntimeError(f"shard {shard} lacks slots")
        files.write(f"{out}/shard-{shard:08d}.bin", b"".join(r[4] for r in rows))
        return pa.table({
            "slot": pa.array(slots, pa.int64()), "shard": pa.array([shard] * len(rows), pa.int32()),
            "byte_offset": pa.array([(s - first) * stride for s in slots], pa.int64()),
            "n_tokens": pa.array([r[1] for r in rows], pa.int32()), "doc_ids": pa.array([r[2] for r in rows], pa.list_(_id(kept))),
            "starts": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            "sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string()),
        })

    return run


def materialise(docs: DataFrame, out: str, *, text="text", ident="doc_id", tokenizer=TOKENIZER, length: int = 2048,
                shard_bytes: int = 8 << 20, seed: int = 20240507) -> DataFrame:
    """Write the shards below ``out``; the result has one row per sequence: slot, shard, byte_offset, n_tokens, doc_ids, starts, sha256."""
    spark = docs.sparkSession
    common.ship(spark)
    ranks = vocabulary(tokenizer)
    whole = docs.schema[ident].dataType.typeName() in ("byte", "short", "integer", "long")
    kept = "long" if whole else "string"
    end = max(ranks.values()) + 1
    width, kind = (2, "H") if end < 1 << 16 else (4, "I")
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary file: its size is fixed
    rows = docs.select(common.q(ident).try_cast(kept).alias("id"), common.q(text).alias("t"))
    made = common.written(rows.mapInArrow(_tokenise(shared, length, end, kind, kept), _SCHEMA.format(kept)), "sequences")
    counts = sorted((r[0], r[1]) for r in made.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    per_shard = max(1, shard_bytes // (length * width))
    files.write(f"{out}/meta.json", json.dumps({"length": length, "width": width, "sequences": total, "per_shard": per_shard, "end": end, "seed": seed,
                                               "tokenizer": tokenizer.rsplit("/", 1)[-1]}).encode())
    base = np.cumsum([0, *(n for _, n in counts)])[:-1].tolist() if counts else []
    # One row per input partition.
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, base, strict=True)], "part int, base long")
    placed = made.join(F.broadcast(bases), "part").withColumn("slot", permuted(F.col("base") + F.col("k"), max(total, 1), seed))
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)")).drop("part", "k", "base")
    placed = placed.mapInArrow(lambda batches: _shrink(batches, kept), _PACKED.format(kept))
    schema = f"slot long, shard int, byte_offset long, n_tokens int, doc_ids array<{kept}>, starts array<int>, sha256 string"
    manifest = common.written(placed.groupBy("shard").applyInArrow(_write(out, width, length, per_shard, kept), schema), "manifest")
    common.forget(made)
    return manifest


def read_slots(out: str, start: int, count: int | None = None):
    """Yield the token arrays of slots ``start``, ``start`` + 1 ..., reading only what they span."""
    meta = json.loads(files.read(f"{out}/meta.json"))
    stop = meta["sequences"] if count is None else min(meta["sequences"], start + count)
    stride, per = meta["length"] * meta["width"], meta["per_shard"]
    while start < stop:
        shard, last = start // per, min(stop, (start // per + 1) * per)
        data = files.read(f"{out}/shard-{shard:08d}.bin", (start - shard * per) * stride, (last - start) * stride)
        yield from np.frombuffer(data, np.uint16 if meta["width"] == 2 else np.uint32).reshape(-1, meta["length"])
        start = last


def shards_of(docs: DataFrame, **options) -> DataFrame:
    """``materialise`` into a fresh path of the shared folder."""
    return materialise(docs, common.scratch(docs.sparkSession, "tokens"), **options)
