"""WARC archives: a deduplicating writer and a salvage reader.

Writer: pages with equal payloads have one response, that of the least page id; the
others are revisit records that refer to it.  Each record is a gzip member of its own.
Map tasks write archives of about ``archive_bytes`` under fresh names and report them;
only reported archives count, so a repeated or lost task leaves no trace in the result.

Reader: a record must unpack, carry a version line, parse, have its full length and
agree with its digests.  Where a check fails, the reader searches for the next place
at which a member (or, in a plain archive, a version line) begins that passes, goes on
there, and logs the bytes between as a quarantined gap.  Files are read in chunks;
memory is bounded by the largest record: before a plain record is read, its claimed end
is probed.  Digests are checked where their algorithm is known, in hex or base32.

Defined cases: null html is an empty payload; a very long one is held whole, once; payloads
below ``least_bytes`` are always responses; of repeated rows with the least page id every
one is a response; a null page id counts as the largest; ids may have any type and
length; white space and control characters of ids and URLs are percent-encoded in the
archive; other columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common, files

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_ONCE = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
_DATE = "2024-01-01T00:00:00Z"
_PAGE = "urn:page:"
_DIGESTS = ("md5", "sha1", "sha256", "sha512")
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def agrees(claimed: str, data: bytes) -> bool:
    """Whether ``claimed`` (algorithm:value) is the digest of ``data``; true where the algorithm isn't known."""
    algorithm, _, value = claimed.partition(":")
    if algorithm.lower().replace("-", "") not in _DIGESTS:
        return True
    made = hashlib.new(algorithm.lower().replace("-", ""), data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def one_line(url: str) -> str:
    """``url`` without white space and control characters: percent-encoded."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, first, revisit: bool) -> bytes:
    """One record, uncompressed."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    named = f"<{_PAGE}{quote(str(page_id), safe='')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {one_line(url or '')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PAGE}{quote(str(first), safe='')}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict, bytes] | None:
    """Headers and block of a record, or None if a check fails."""
    if not data.startswith(_VERSION):
        return None
    data = bytes(data)
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    version, *lines = data[:end].split(b"\r\n")
    if len(version) != len(_VERSION) + 1:
        return None
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon or key.strip().lower() in _ONCE and key.strip().lower().decode() in headers:  # two records run together
            return None
        headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or data[end + 4 + int(size) :] != b"\r\n\r\n":
        return None
    block = data[end + 4 : end + 4 + int(size)]
    if "warc-block-digest" in headers and not agrees(headers["warc-block-digest"], block):
        return None
    claimed = headers.get("warc-payload-digest")
    if claimed and headers.get("warc-type") == "response" and not agrees(claimed, block.partition(b"\r\n\r\n")[2]):
        return None
    return headers, block


class Window:
    """A file read forward in chunks; bytes before ``drop`` are let go.  ``probe(offset, size)`` reads elsewhere, if given."""

    def __init__(self, stream, chunk: int = 1 << 20, probe=None):
        self.stream, self.chunk, self.base, self.data, self.ended, self.probe = stream, chunk, 0, bytearray(), False, probe

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(self.chunk)
        self.ended = not got
        self.data += got
        return not self.ended

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.base]
        self.base = upto


def _member_at(w: Window, start: int):
    """(record, end) of a gzip member, or None."""
    z, at, out = zlib.decompressobj(31), start, []
    size = 0
    while not z.eof:
        piece = w.data[at - w.base : at - w.base + (1 << 16)]
        if not piece:
            if not w.more():
                return None
            continue
        try:
            made = z.decompress(piece)
        except zlib.error:
            return None
        if not size and made and not made.startswith(_VERSION[: len(made)]):
            return None
        out.append(made)
        size += len(made)
        at += len(piece) - len(z.unused_data)
    found = parse(b"".join(out))
    return found and (found, at)


def _plain_at(w: Window, start: int):
    """(record, end) of an uncompressed record, or None."""
    while (end := w.data.find(b"\r\n\r\n", start - w.base)) < 0:
        if len(w.data) - (start - w.base) > 1 << 16 or not w.more():
            return None
    size = next((v.strip() for k, _, v in (x.partition(b":") for x in w.data[start - w.base : end].split(b"\r\n")) if k.strip().lower() == b"content-length"), b"")
    if not size.isdigit():
        return None
    stop = end + 4 + int(size) + 4
    if w.probe and w.probe(w.base + stop - 4, 4) != b"\r\n\r\n":  # the length is damaged: don't read so far
        return None
    while len(w.data) < stop:
        if not w.more():
            return None
    found = parse(w.data[start - w.base : stop])
    return found and (found, w.base + stop)


def salvage(stream, chunk: int = 1 << 20, probe=None):
    """Yield ("record", start, end, headers, block) and ("gap", start, end, None, None) in file order."""
    w = Window(stream, chunk, probe)
    at = 0
    while True:
        while len(w.data) - (at - w.base) < len(_VERSION) and w.more():
            pass
        if at - w.base >= len(w.data) and w.ended:
            return
        found = _try(w, at)
        gap = at
        while not found:
            at = _next(w, at + 1)
            if at < 0:
                yield "gap", gap, w.base + len(w.data), None, None
                return
            found = _try(w, at)
        if gap < at:
            yield "gap", gap, at, None, None
        (headers, block), end = found
        yield "record", at, end, headers, block
        at = end
        w.drop(at)


def _try(w: Window, at: int):
    head = w.data[at - w.base : at - w.base + len(_VERSION)]
    return _member_at(w, at) if head.startswith(_MAGIC) else _plain_at(w, at) if head == _VERSION else None


def _next(w: Window, start: int) -> int:
    """Next place that looks like a member or a version line."""
    while True:
        data = w.data
        places = [p for p in (data.find(_MAGIC, start - w.base), data.find(_VERSION, start - w.base)) if p >= 0]
        if places:
            at = min(places) + w.base
            w.drop(at)
            return at
        start = max(start, w.base + len(data) - len(_VERSION) + 1)
        w.drop(start)
        if not w.more():
            return -1


_WRITTEN = "path string, records long, bytes long"


def write(pages: DataFrame, out: str, *, ident="page_id", url="url", html="html", least_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives below ``out``; the result lists them: path, records, bytes."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(common.q(ident).alias("id"), (common.q(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"),
                        F.coalesce(common.q(html), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"sha": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    # Written, so that the join meets plain tables on both sides and can split a very common payload.
    first = common.written(rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    joined = rows.join(first, ["sha", "size"], "left").select("id", "url", "body", "first")

    def run(batches):
        where, path = files.at(out)
        where.create_dir(path, recursive=True)
        name = stream = None
        count = size = 0
        done = []
        for batch in batches:
            for ident_, url_, body, first_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if stream is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = where.open_output_stream(f"{path}/{name}", compression=None)
                data = member(record(ident_, url_, body, first_, first_ is not None and ident_ != first_))
                stream.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    stream.close()
                    done.append((f"{out}/{name}", count, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{out}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return common.written(joined.mapInArrow(run, _WRITTEN), "archives")


_READ = "path string, start long, stop long, kind string, record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives listed in ``path``: kind is record or gap; a gap has only its place."""
    common.ship(archives.sparkSession)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = files.at(path)
                rows, size = [], 0
                with where.open_input_stream(name, compression=None) as stream, where.open_input_file(name) as whole:
                    length_ = whole.size()
                    for kind, start, stop, headers, block in salvage(stream, probe=lambda at, n: whole.read_at(n, at) if at + n <= length_ else b""):
                        if kind == "gap":
                            rows.append((path, start, stop, kind, *[None] * 7))
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        claimed = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        full = headers.get("warc-type") != "revisit"
                        length = len(body) if full else next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        rows.append((path, start, stop, kind, headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), headers.get("warc-type"),
                                     headers.get("warc-refers-to", "").strip("<>") or None, length, digest(body) if full else claimed, body if full and payload else None))
                        size += len(body)
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield _read_batch(rows)
                            rows, size = [], 0
                yield _read_batch(rows)

    return archives.select("path").mapInArrow(run, _READ)


def _read_batch(rows):
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back, in the contract's columns."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    archives = write(pages, common.scratch(spark, "warc"))
    # A task for each archive.
    back = read(archives.repartition(max(1, archives.count())), payload=False).where("kind = 'record'")

    def page(c):
        return F.when(F.col(c).startswith(_PAGE), F.url_decode(F.col(c).substr(F.lit(len(_PAGE) + 1), F.length(c)))).cast(kind)

    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
