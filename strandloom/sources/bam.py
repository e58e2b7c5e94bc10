"""BAM files, decoded in Python tasks: one task per file, memory bounded by one block and one record."""

from __future__ import annotations

import io
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.functions.scalar import overlaps

from strandloom.schema import CIGAR_OPS

# Fixed values of the format: packed bases and the sizes of integer tag values.
_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
SCHEMA = "header string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


def inflate(stream) -> io.BufferedReader:
    """A BGZF file as a plain stream: gzip members, one after the other."""

    class Raw(io.RawIOBase):
        def __init__(self):
            self.z, self.held, self.out = zlib.decompressobj(31), b"", b""

        def readable(self):
            return True

        def readinto(self, into):
            while not self.out:
                if self.z.eof:
                    self.held, self.z = self.z.unused_data, zlib.decompressobj(31)
                data = self.held or stream.read(1 << 16)
                self.held = b""
                if not data:
                    return 0
                self.out = self.z.decompress(data)
            n = min(len(into), len(self.out))
            into[:n], self.out = self.out[:n], self.out[n:]
            return n

    return io.BufferedReader(Raw(), 1 << 16)


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in _SIZES:
            value, at = struct.unpack_from(_SIZES[kind], data, at)[0], at + struct.calcsize(_SIZES[kind])
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        else:
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            value = ",".join([sub, *map(str, struct.unpack_from(f"<{n}{_SIZES[sub][1]}", data, at + 5))])
            at += 5 + n * struct.calcsize(_SIZES[sub])
        out[name] = str(value)
    return out


def records(stream):
    """Tuples in the order of ``SCHEMA``; positions count from 1, as in SAM."""
    f = inflate(stream)
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    while head := f.read(4):
        body = f.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
        at = 32
        header, at = body[at : at + l_name - 1].decode(), at + l_name
        ops = struct.unpack_from(f"<{n_ops}I", body, at)
        at += 4 * n_ops
        packed, at = body[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        qual, at = body[at : at + l_seq], at + l_seq
        where = lambda i: names[i] if i >= 0 else "*"
        mate = "=" if next_ref == ref and ref >= 0 else where(next_ref)
        yield (header, flag, where(ref), pos + 1, mapq, "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*", mate, next_pos + 1, tlen, seq or "*",
               "*" if not l_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode("latin-1"), _tags(body[at:]))


def read_bam(spark: SparkSession, path: str, *, least_mapq: int | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Records of BAM files; optionally of mapping quality ``least_mapq`` or more, or that overlap (rname, first, last)."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for r in records(io.BytesIO(content)):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
    if least_mapq is not None:
        out = out.where(out.mapq >= least_mapq)
    if region is not None:
        out = out.where(overlaps(*region))
    return out


def _batch(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if " int" in c else pa.map_(pa.string(), pa.string()) if "map<" in c else pa.string() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
