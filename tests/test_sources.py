import gzip
import struct

from pyspark.sql import functions as F

from strandloom.functions import codon, scalar
from strandloom.operators import samtools, simulate
from strandloom.operators.table import SeqTable
from strandloom.plans import catalog
from strandloom.schema import TableInfo
from strandloom.sources import bam, text

SAM = "@HD\tVN:1.0\n@SQ\tSN:ref\tLN:99\nr1\t99\tref\t1\t30\t4M\t=\t9\t0\tACGT\tIIII\tXN:i:0\tMD:Z:4\nr1\t147\tref\t2\t9\t2M1I1M\t=\t1\t0\tCGGT\t55II\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_sam(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text(SAM)
    df = text.read_sam(spark, str(p))
    rows = {(r.header, r.flag): r for r in df.collect()}
    assert len(rows) == 3 and rows["r1", 99].tags == {"XN": "0", "MD": "4"} and rows["r1", 99].pos == 1
    assert text.read_sam(spark, str(p), tags=["MD"], fields=["header", "seq"], rows=1).columns == ["header", "seq", "MD"]
    t = SeqTable.from_sam(spark, str(p), least_mapq=10)
    assert [r.seq for r in t.df.collect()] == ["ACGT"]
    good, bad, stats = samtools.filtered(df, debug=str(tmp_path / "bad"))
    assert {r.reason: r.reads for r in stats.collect()} == {"good": 1, "indel": 1, "invalid_hit": 1}
    assert samtools.mates(df.where("flag <> 4")).first().r1.pos == 1
    filled = {r.flag: r for r in samtools.fill_mates(df.where("flag <> 4")).collect()}
    assert filled[99].pnext == 2 and filled[147].rnext == "="


def test_bam(spark, tmp_path):
    def rec(name, flag, ref, pos, ops, seq, qual):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 40, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=XB".index(o)) for n, o in ops) + packed + bytes(qual) + b"NMC\x02XSZhi\0"
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"ref\0" + struct.pack("<i", 99)
    data += rec("q1", 0, 0, 2, [(3, "M"), (2, "S")], "ACGTT", [40, 41, 2, 3, 4]) + rec("q2", 16, -1, -1, [], "AC", [255, 255])
    p = tmp_path / "x.bam"
    p.write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    rows = {r.header: r for r in bam.read_bam(spark, str(p)).collect()}
    q = rows["q1"]
    assert (q.pos, q.cigar, q.seq, q.qual, q.rname, q.tags) == (3, "3M2S", "ACGTT", "IJ#$%", "ref", {"NM": "2", "XS": "hi"})
    assert rows["q2"].rname == "*" and rows["q2"].qual == "*" and rows["q2"].cigar == "*"
    assert SeqTable.from_bam(spark, str(p)).df.first().seq == "ACG"
    # A region keeps what overlaps it: q1 lies on 3 to 5.
    assert [bam.read_bam(spark, str(p), region=("ref", a, b)).count() for a, b in ((4, 9), (1, 3), (6, 9), (1, 2))] == [1, 1, 0, 0]


def test_fastq(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text("".join(f"@h{i}\n{'ACGT'[i % 4] * 5}\n+\n@III{i % 10}\n" for i in range(50)))
    df = text.read_fastq(spark, str(p))
    rows = df.orderBy("read_ord").collect()
    assert len(rows) == 50 and rows[3].header == "h3" and rows[3].seq == "TTTTT" and rows[3].qual == "@III3"
    assert text.read_fastq(spark, str(p), limit=7).count() == 7
    out = str(tmp_path / "out")
    text.write_fastq(df, out)
    text.write_fastq(df.drop("header"), out, append=True)
    assert sorted(r.header for r in text.read_fastq(spark, out).collect())[-1].startswith("insilica_seq_")


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first\nacgt\nAC\n\n>two\nTTT\n")
    assert [tuple(r) for r in text.read_fasta(spark, str(p)).orderBy("id").collect()] == [("one", "ACGTAC"), ("two", "TTT")]


def test_fasta_keeps_every_line(spark, tmp_path):
    p = tmp_path / "long.fa"
    n = (1 << 20) + 5
    p.write_text(">long\n" + "A\n" * n + "C\n>none\n")
    got = text.read_fasta(spark, str(p)).select("id", F.length("seq").alias("n"), F.right("seq", F.lit(2)).alias("end")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("long", n + 1, "AC"), ("none", 0, "")]


def test_flags_and_cigars(spark):
    df = spark.createDataFrame([(99, "5S3M1I2M4S"), (147, "bad"), (0, "3M")], "flag int, cigar string")
    rows = df.select(scalar.flag_bits("flag").alias("b"), scalar.read_number("flag").alias("n"), scalar.leading_clip("cigar").alias("l"), scalar.trailing_clip("cigar").alias("t"),
                     F.size(scalar.cigar_ops("cigar")).alias("k"), scalar.cigar_total("cigar", "M").alias("m")).collect()
    assert [tuple(r) for r in rows] == [([0, 1, 5, 6], "R1", 5, 4, 5, 5), ([0, 1, 4, 7], "R2", 0, 0, 0, 0), ([], "R1", 0, 0, 1, 3)]


def test_codons(spark):
    df = spark.createDataFrame([("atgacnnnntaa",), ("AT",), ("",)], "s string")
    assert [r[0] for r in df.select(codon.translate("s")).collect()] == ["MTX*", "", ""]
    assert [r[0] for r in df.select(codon.translate("s", 1, True)).collect()] == ["*XXX", "X", ""]
    assert len(codon.codon_table()) == 125 and codon.codon_table()["CTN"] == "L"
    assert codon.degenerate_regex("ANR") == "A[ACGT][AG]"
    assert codon.library_alignment("TTACGACC", "ACNA") == {"start": 2, "sequence": "ACGA", "nt": [0, 0, 0, 0, 1, 0, 0, 0], "residues": [0, 1]}


def test_simulation(spark):
    lib = simulate.qualities(simulate.library(spark, "ACGTACGTAC", 400, saturated=[2], codes={2: "R"}, error_rate=0.2, spared=[1]))
    rows = lib.collect()
    assert {r.seq[0] for r in rows} == {"A"} and all(len(r.seq) == len(r.qual) == 10 for r in rows)
    assert sum(r.seq[1] in "AG" for r in rows) > 300
    changed = sum(a != b for r in rows for a, b in zip(r.seq[2:], "GTACGTAC", strict=True)) / (400 * 8)
    assert 0.1 < changed < 0.2
    mean = [sum(ord(r.qual[i]) - 33 for r in rows) / 400 for i in (0, 9)]
    assert mean[0] > 30 > 20 > mean[1]
    moved = simulate.indels(lib, insertion=0.05, deletion=0.05).collect()
    assert all(len(r.seq) == len(r.qual) for r in moved) and len({len(r.seq) for r in moved}) > 2
    assert simulate.scratch(spark, 5, 30).first().seq.__len__() == 30


def test_stream(spark, tmp_path):
    from strandloom.streaming import running

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.sam").write_text(SAM)
    s = running.sam_stream(spark, str(src)).where("cigar = '4M'").withColumn("read_id", F.col("header"))
    out = running.to_memory(running.running_distribution(s, TableInfo(first=1, last=4)), "dist_test", str(tmp_path / "ck"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", 1), (2, "C", 1), (3, "G", 1), (4, "T", 1)]


def test_catalog_is_paired():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_external_aligner(spark):
    import sys

    from strandloom.operators import external

    fake = "import sys\nprint('@HD')\nls=sys.stdin.read().split('\\n')\nfor i in range(0,len(ls)-1,4): print('\\t'.join([ls[i][1:],'0' if 'C' in ls[i+1] else '4','ref','1','9',str(len(ls[i+1]))+'M','*','0','0',ls[i+1],ls[i+3]]))"
    reads = spark.createDataFrame([(f"h{i}", "ACGT" if i % 2 else "GGGG", "IIII") for i in range(20)], "header string, seq string, qual string")
    out = external.align(reads, [sys.executable, "-c", fake])
    assert out.count() == 20 and samtools.unaligned(reads, out).count() == 10
    import pytest

    with pytest.raises(Exception, match="ended with 3"):
        external.align(reads, [sys.executable, "-c", "import sys; sys.exit(3)"]).collect()
    with pytest.raises(RuntimeError):
        external.run_tool([sys.executable, "-c", "raise SystemExit(1)"])


def test_back_to_fastq_and_fasta_tools(spark):
    df = spark.createDataFrame([("a", 16, "AACG", "ABCD"), ("b", 0, "AC", "IJ"), ("c", 256, "A", "I")], "header string, flag int, seq string, qual string")
    assert [tuple(r) for r in samtools.to_fastq(df).collect()] == [("a", "CGTT", "DCBA"), ("b", "AC", "IJ")]
    fa = spark.createDataFrame([("x", "ACGTACGT")], "id string, seq string")
    assert samtools.fetch(fa, spark.createDataFrame([("x", 3, 5)], "id string, start int, stop int")).first().seq == "GTA"
    assert samtools.dictionary(fa).first().length == 8
    v = spark.createDataFrame([("1.0.post1",), ("1.0-x",)], "v string").select(scalar.canonical_version("v")).collect()
    assert [r[0] for r in v] == [True, False]


def test_one_hot_pairs(spark):
    from strandloom.operators import compare

    t = SeqTable.from_list(spark, ["ACGN", "ACGT"])
    got = {(r.read_id, r.other_id): r.distance for r in compare.pairwise(t.df, t.info, t.df, one_hot=True).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (2, 2): 0}
