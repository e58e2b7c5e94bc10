import base64
import hashlib
import io
import os
import random

import pytest

from strandloom.llm import common, warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}\nx", "".join(rng.choice("ab<p>é") for _ in range(rng.randrange(300)))) for i in range(40)]
    rows += [(40, None, rows[3][2]), (41, "u", None), (42, "u", ""), (43, "u", rows[3][2]), (7, rows[7][1], rows[7][2]), (44, "u", "z" * 300_000), (None, "u", rows[3][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    by = {}
    for r in rows:
        if r[0] is not None:
            by[r[2] or ""] = min(by.get(r[2] or "", r[0]), r[0])
    out = []
    for r in rows:
        data = (r[2] or "").encode()
        first = by.get(r[2] or "")
        revisit = first is not None and r[0] != first
        out.append((r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(pages):
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(expected(pages.collect()), key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark, pages, tmp_path):
    listed = warc.write(pages, f"file://{tmp_path}/w", least_bytes=1000, archive_bytes=2000)
    assert listed.count() > 3
    back = warc.read(listed)
    assert {r.record_type for r in back.collect()} == {"response"}
    assert sorted(bytes(r.payload).decode() for r in back.collect()) == sorted(r.html or "" for r in pages.collect())


def archive(n=30, zipped=True):
    parts = [warc.record(i, f"http://x/{i}", f"body {i} ".encode() * (i + 1), None, False) for i in range(n)]
    return [warc.member(p) for p in parts] if zipped else parts


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_salvage(zipped, chunk):
    parts = archive(12, zipped)
    assert [x[0] for x in warc.salvage(io.BytesIO(b"".join(parts)), chunk)] == ["record"] * 12
    bad = list(parts)
    bad[3] = bad[3][: len(bad[3]) // 2]  # cut off
    k = len(bad[7]) - 30  # in the body, or in the compressed data
    bad[7] = bad[7][:k] + bytes([bad[7][k] ^ 0xFF]) + bad[7][k + 1 :]  # flipped
    bad[9] = b"junk WARC/1.1 junk\x1f\x8b\x08 junk" + bad[9]
    data = b"".join(bad)
    found = list(warc.salvage(io.BytesIO(data), chunk))
    good = [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    assert good == [f"<urn:page:{i}>" for i in range(12) if i not in (3, 7)]
    at = 0
    for _, start, stop, _, _ in found:  # every byte is in a record or a gap
        assert start == at and stop > start
        at = stop
    assert at == len(data)
    starts = [sum(map(len, bad[:i])) for i in range(13)]
    gaps = [(s, e) for kind, s, e, _, _ in found if kind == "gap"]
    assert (starts[3], starts[4]) in gaps and (starts[7], starts[8]) in gaps and len(gaps) == 3


def test_salvage_of_rubbish():
    noise = os.urandom(5000)
    assert [x[0] for x in warc.salvage(io.BytesIO(noise), 100)] == ["gap"] and list(warc.salvage(io.BytesIO(b""))) == []
    whole = b"".join(archive(3))
    assert [x[0] for x in warc.salvage(io.BytesIO(whole[:-5]))] == ["record", "record", "gap"]


def test_reader_logs_gaps(spark, tmp_path):
    parts = archive(5)
    p = tmp_path / "a.warc.gz"
    p.write_bytes(parts[0] + parts[1][:40] + parts[2] + b"xx" + parts[3])
    rows = warc.read(spark.createDataFrame([(f"file://{p}",)], "path string")).collect()
    assert [r.kind for r in rows] == ["record", "gap", "record", "gap", "record"] and rows[1].stop - rows[1].start == 40


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file://") and common.scratch(spark, "x") != common.scratch(spark, "x")


def test_long_and_odd_ids_come_back(spark):
    rows = [("a" * 90, "http://x/\nWARC-Type: response", "same"), ("b <c>\n+%41" * 9, "http://y/ z", "same"), ("é" * 50, None, None)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == {r[0] for r in rows} and got[rows[1][0]].refers_to == rows[0][0] and got[rows[0][0]].record_type == "response"


def test_a_damaged_length_is_not_read(monkeypatch):
    import io

    records = [warc.record(i, "u", bytes([65 + i % 20]) * 50_000, None, False) for i in range(100)]
    records[3] = records[3].replace(b"Content-Length: 50", b"Content-Length: 450", 2)
    data = b"".join(records)
    most = []
    more = warc.Window.more
    monkeypatch.setattr(warc.Window, "more", lambda w: (more(w), most.append(len(w.data)))[0])
    found = list(warc.salvage(io.BytesIO(data), 1 << 16, lambda at, n: data[at : at + n]))
    assert sum(f[0] == "record" for f in found) == 99 and sum(f[0] == "gap" for f in found) == 1 and max(most) < 300_000


def test_digests_by_their_algorithm():
    import base64

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    h = hashlib.sha256(block)
    for value, good in ((f"sha256:{h.hexdigest()}", True), ("sha256:" + base64.b32encode(h.digest()).decode(), True), ("sha256:00", False), ("sha1:" + hashlib.sha1(block).hexdigest(), True), ("blake3:xyz", True), ("sha1:ABC", False)):
        data = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: {value}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
        assert (warc.parse(data) is not None) == good, value
