import hashlib
import math

import pytest
from pyspark.sql import functions as F

from strandloom.operators import align, compare, logo
from strandloom.operators.table import SeqTable, merge_tables
from strandloom.schema import INSERTIONS, TableInfo

SIX = ["ACGT", "AAAA", "ATGA", "ATCG", "CCCC", "GGGG"]


@pytest.fixture(scope="module")
def six(spark):
    return SeqTable.from_list(spark, SIX)


def grid(df, value="distance"):
    out = {}
    for r in df.collect():
        out.setdefault(r.read_id, {})[r.ref_id] = r[value]
    return [tuple(out[i][j] for j in sorted(out[i])) for i in sorted(out)]


def matches(table, **options):
    c = table.compare_to_references(SIX[:2], **options)
    return grid(c.groupBy("read_id", "ref_id").agg(F.sum(F.col("is_match").cast("int")).alias("n")), "n")


def test_matches(six):
    assert matches(six) == [(4, 1), (1, 4), (2, 2), (1, 1), (1, 0), (1, 0)]
    assert matches(six, treat=["A"]) == [(4, 4), (4, 4), (3, 4), (1, 4), (2, 4), (2, 4)]
    assert matches(six, treat=["A", "G"]) == [(4, 4), (4, 4), (3, 4), (3, 4), (3, 4), (4, 4)]


def test_hamming(six):
    assert grid(six.hamming_distance(SIX[:2])) == [(0, 3), (3, 0), (2, 2), (3, 3), (3, 4), (3, 4)]


def test_flip_ignore_treat(six):
    rows = six.compare_to_references(SIX[:2], flip=True, ignore=["C", "G"], treat=["A", "T"]).collect()
    cube = {(r.read_id, r.ref_id, r.position): r.is_match for r in rows}
    show = lambda n, m: "".join("." if cube[n, m, p] is None else str(int(cube[n, m, p])) for p in range(1, 5))
    assert [show(1, 1), show(1, 2), show(2, 1), show(2, 2), show(3, 1), show(3, 2), show(4, 1), show(4, 2)] == ["0..0", "0..0", "0..0", "0000", "0..0", "00.0", "0...", "00.."]
    assert show(5, 1) == show(6, 2) == "...."


def test_entropy_bits_consensus(six):
    e = {r.position: r.entropy for r in six.pos_entropy().collect()}
    assert [round(e[p], 6) for p in (1, 2, 3, 4)] == [1.251629, 1.918296, 1.459148, 1.918296]
    rel = {r.position: r.relative_entropy for r in six.relative_entropy().collect()}
    assert round(rel[1], 6) == 0.518731 and round(rel[3], 6) == 0.37489
    bits = {(r.position, r.letter): r.value for r in six.seq_dist(method="bits").collect()}
    assert round(bits[1, "A"], 6) == 0.378689 and bits[2, "C"] == 0 and round(bits[3, "G"], 6) == 0.180258
    assert six.consensus().first()[0] == "ANNN"
    assert six.consensus(cutoff=0.4).first()[0] == "ANGN"


def test_plogo_values(six):
    out = {(r.position, r.letter): r.log_odds for r in six.plogo()[0].collect()}
    assert math.isclose(out[1, "A"], 1.422820, abs_tol=1e-6) and math.isclose(out[2, "A"], -0.187394, abs_tol=1e-6)


def test_plogo_cap_and_tails():
    assert math.isinf(logo.log_odds(90_000, 100_000, 0.25)) and not math.isinf(logo.log_odds(90_000, 100_000, 0.25, exact=True))
    assert 0 < logo.cap(100_000, 0.25 / 100_000) < math.inf
    n, p = 40, 0.3
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    for k in (0, 1, 7, 12, 30, 40):
        above, below = logo.tails(k, n, p)
        assert math.isclose(math.exp(above), sum(pmf[k:]), rel_tol=1e-9) and math.isclose(math.exp(below), sum(pmf[: k + 1]), rel_tol=1e-9)


READS = [("r1", "ACGTACGT", "IIIIIIII", 1, "8M"), ("r2", "ACGGTTACGT", "IIII55IIII", 1, "4M2I4M"), ("r3", "ACGACGT", "IIIIIII", 1, "3M1D4M"), ("r4", "TTGTACG", "##IIIII", 3, "2S5M"), ("r5", "ACGT", "5555", 1, "2M3N2M")]


@pytest.fixture(scope="module")
def aligned(spark):
    return spark.createDataFrame(READS, "header string, seq string, qual string, pos int, cigar string")


def test_cigar(aligned):
    t = SeqTable.from_df(aligned)
    assert (t.info.first, t.info.last) == (1, 8)
    got = {r.read_id: (r.seq, r.qual) for r in t.df.collect()}
    assert got == {"r1": ("ACGTACGT", "IIIIIIII"), "r2": ("ACGGACGT", "IIIIIIII"), "r3": ("ACG-ACGT", "III!IIII"), "r4": ("$$GTACG$", "!!IIIII!"), "r5": ("AC...GT$", "55!!!55!")}
    ins = sorted(tuple(r) for r in t.df.select(F.inline("insertions")).collect())
    assert ins == [(5, -2, "T", 20), (5, -1, "T", 20)]
    assert [tuple(r) for r in t.insertion_events().collect()] == [(5, 1)]
    for how, value in (("mean", -1.5), ("median", -1.5), ("max", -2)):
        assert t.insertion_expectations(method=how).first().loc == value


def test_cigar_window(aligned):
    t = SeqTable.from_df(aligned, first=3, last=6)
    assert {r.read_id: (r.seq, r.qual) for r in t.df.collect()} == {"r1": ("GTAC", "IIII"), "r2": ("GGAC", "IIII"), "r3": ("G-AC", "I!II"), "r4": ("GTAC", "IIII"), "r5": ("...G", "!!!5")}
    one = SeqTable.from_df(aligned, first=5, last=5)
    assert {r.read_id: r.seq for r in one.df.collect()}["r3"] == "A"


def test_cigar_edges(spark):
    rows = [("a", "ACGT", "IIII", 10, "4M"), ("b", "ACGT", "IIII", 1, "4M"), ("c", "ACGT", "IIII", 4, "1H4M2P"), ("d", "AC", "II", 1, "*")]
    df = spark.createDataFrame(rows, "header string, seq string, qual string, pos int, cigar string")
    out, first, last = align.project(df, first=5, last=8)
    got = {r.header: r.seq for r in out.collect()}
    assert got == {"a": "$$$$", "b": "$$$$", "c": "CGT$"}
    with pytest.raises(Exception, match="CIGAR operation B"):
        align.project(spark.createDataFrame([("x", "AC", "II", 1, "1M1B1M")], df.schema), first=1, last=3)[0].collect()


def test_place_and_padding(spark):
    df = spark.createDataFrame([("AACGA", "IIIII", 1), ("CG", "II", 4)], "seq string, qual string, pos int")
    out, first, last = align.place(df, first=3)
    assert [r.seq for r in out.collect()] == ["CGA", "$CG"] and (first, last) == (3, 5)
    t = SeqTable.from_list(spark, ["ACG", "A"], ["III", "I"])
    assert [(r.seq, r.qual) for r in t.df.orderBy("read_ord").collect()] == [("ACG", "III"), ("ANN", "I!!")]
    assert SeqTable.from_list(spark, ["MFL", "M"]).info.fill == "X"
    with pytest.raises(ValueError):
        SeqTable.from_list(spark, ["ACG"], ["II"])
    with pytest.raises(ValueError):
        TableInfo("RNA")


def test_words(spark):
    t = SeqTable.from_list(spark, ["ACTW", "ATTA"], seq_type="AA")
    got = {(tuple(r.positions), r.word): r.value for r in t.substrings(3).collect()}
    assert got == {((1, 2, 3), "ACT"): 1, ((1, 2, 3), "ATT"): 1, ((1, 2, 4), "ACW"): 1, ((1, 2, 4), "ATA"): 1, ((1, 3, 4), "ATW"): 1, ((1, 3, 4), "ATA"): 1, ((2, 3, 4), "CTW"): 1, ((2, 3, 4), "TTA"): 1}


def test_quality(spark):
    t = SeqTable.from_list(spark, ["AAA", "ACT", "ACA"], ["ZCA", "DGJ", "JJJ"])
    assert [r.q for r in t.qualities().orderBy("read_id").collect()] == [[57, 34, 32], [35, 38, 41], [41, 41, 41]]
    assert sorted(r.read_id for r in t.quality_filter(35, 60).df.collect()) == [2, 3]
    assert [r.seq for r in t.low_bases_to_null(35).sequences().orderBy("read_id").collect()] == ["ANN", "ACT", "ACA"]
    masked = t.low_bases_to_null(35).seq_dist().where("letter = 'N'").agg(F.sum("value")).first()[0]
    assert masked == 2


def test_slices_and_insertions(spark, aligned):
    t = SeqTable.from_list(spark, ["ACGT", "TTTT"])
    assert [r.seqs for r in t.slices([0, 2, 1, 5, 6], empty="N", ordered=True).collect()] == ["NCANN", "NTTNN"]
    s = {r.read_id: r.seqs for r in SeqTable.from_df(aligned).strings_with_insertions().collect()}
    assert s["r2"] == "ACGGttACGT" and s["r1"] == "ACGT--ACGT"
    assert SeqTable.from_df(aligned).with_insertions(least=1).where("loc < 0").count() == 0


def test_pairs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(compare, "_PAIRS", 100)
    seqs = ["".join("ACGT"[i * i * k % 7 % 4] for i in range(1, 24)) for k in range(1, 41)]
    t = SeqTable.from_list(spark, seqs)
    for one_hot in (False, True):
        found = compare.pairwise(t.df.coalesce(1), t.info, t.df, one_hot=one_hot)
        assert found.rdd.getNumPartitions() == 16  # one file is not one task
        plan = found._jdf.queryExecution().executedPlan().toString()
        exchange = plan.index("Exchange RoundRobin")  # letters are packed below it, once for a read
        assert not any(x in plan[:exchange] for x in ("conv(", "split("))
        assert {(r.read_id, r.other_id): r.distance for r in found.collect()} == {
            (i, j): sum(x != y for x, y in zip(a, b, strict=True)) for i, a in enumerate(seqs, 1) for j, b in enumerate(seqs, 1)}


def test_merge(spark):
    a, b = SeqTable.from_list(spark, ["ACG", "AAA"], ["III", "III"]), SeqTable.from_list(spark, ["TT"], ["55"], pos=3)
    m = merge_tables([a, b])
    assert [(r.read_id, r.seq, r.qual) for r in m.df.orderBy("read_id").collect()] == [(1, "ACG-", "III!"), (2, "AAA-", "III!"), (3, "--TT", "!!55")]
    over = merge_tables([a, b], axis=1)
    assert {r.read_id: r.seq for r in over.df.collect()} == {1: "ACTT", 2: "AAA-"}
    with pytest.raises(ValueError):
        merge_tables([a, SeqTable.from_list(spark, ["MK"], seq_type="AA")])


def test_merge_numbers_many_partitions(spark):
    n = 20_000
    # So that counts and rows are coalesced unlike each other.
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        order = F.struct(F.col("id") % 7, "id")  # keys may be of any type
        df = spark.range(n).select(F.col("id").alias("read_id"), order.alias("read_ord"), F.md5(F.col("id").cast("string")).alias("seq"), F.repeat(F.lit("I"), F.lit(32)).alias("qual"), F.array().cast(INSERTIONS).alias("insertions"))
        t = SeqTable(df, TableInfo(first=1, last=32))
        rows = merge_tables([t, t]).df.select("read_id", "seq").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [hashlib.md5(str(i).encode()).hexdigest() for i in sorted(range(n), key=lambda i: (i % 7, i))] * 2
    assert sorted((r.read_id, r.seq) for r in rows) == list(enumerate(want, 1))


def test_mutations(six):
    t = six.ts_tv_profile("ACGT").first()
    m = {(r.ref_base, r.read_base): r.value for r in six.mutation_profile("ACGT").collect()}
    assert sum(m.values()) == sum(d for d, in grid(six.hamming_distance("ACGT")))
    ts = sum(v for (a, b), v in m.items() if a + b in ("AG", "GA", "CT", "TC"))
    assert math.isclose(t.ts, ts / sum(m.values())) and math.isclose(t.ts + t.tv, 1)
    with pytest.raises(ValueError):
        SeqTable(six.df, six.info.having(seq_type="AA")).ts_tv_profile("ACGT")


def test_empty_table(spark, six):
    none = six.where(F.lit(False))
    assert none.seq_dist().count() == 0 and none.hamming_distance("ACGT").count() == 0 and none.quality_dist([1]).count() == 0
    assert none.insertion_seq_dist().count() == 0


def test_subsample(six):
    assert six.subsample(3, seed=1).df.count() == 3 and six.subsample(50, replace=True, seed=1).df.count() == 50


def test_properties(six):
    assert {r.s for r in six.seq_dist().groupBy("position").agg(F.sum("value").alias("s")).collect()} == {6}
    assert all(math.isclose(r.s, 1) for r in six.seq_dist(method="freq").groupBy("position").agg(F.sum("value").alias("s")).collect())
    own = {(r.read_id, r.other_id): r.distance for r in __import__("strandloom.operators.compare", fromlist=["x"]).pairwise(six.df, six.info, six.df).collect()}
    assert all(own[a, b] == own[b, a] for a, b in own) and all(own[i, i] == 0 for i in range(1, 7))


def test_packed_hamming_agrees(spark):
    import random

    rng = random.Random(4)
    for width in (1, 7, 8, 31, 600):
        seqs = ["".join(rng.choice("ACGTN-$") for _ in range(width)) for _ in range(12)]
        t = SeqTable.from_list(spark, seqs, seq_type="NT")
        got = {(r.read_id, r.ref_id): r.distance for r in t.hamming_distance(seqs[:3]).collect()}
        assert got == {(i + 1, j + 1): sum(a != b for a, b in zip(seqs[i], seqs[j], strict=True)) for i in range(12) for j in range(3)}
    t = SeqTable.from_list(spark, ["ACGTACGT"], seq_type="NT")
    assert t.hamming_distance("TTTT", [2, 3, 9], ref_positions=[1, 2, 3, 8]).first().distance == 2
    assert t.hamming_distance("AAAA", [2], ref_positions=[8, 2, 4, 1], set_diff=True).first().distance == 2


def test_amino_reads_of_whole_texts(spark, tmp_path):
    from strandloom.plans import catalog, derive

    rows = [(1, "ac" * 20 + "W" * 40 + "d!y"), (2, "x" * 40), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.read_id: r.seq for r in derive.amino_pieces(spark, str(tmp_path)).df.collect()}
    assert got == {"1:0": "AC" * 20, "1:1": "W" * 40, "1:2": "DXY" + "X" * 37, "2:0": "X" * 40, "3:0": "X" * 40}
    assert "W" in {r.letter for r in catalog.QUERIES["seq_dist_bits_aa"](spark, str(tmp_path)).collect()}


def test_type_is_judged_by_all_reads(spark):
    df = spark.range(3000, numPartitions=1).select(F.when(F.col("id") == 2500, "ACGE").otherwise("ACGT").alias("seq"))
    assert align.guess_type(df) == "AA"
    assert align.guess_type(df, rows=1000) == "NT"


def test_cap_is_the_last_finite_count():
    from strandloom.operators import logo

    for n, p in ((50, 1e-6), (3000, 2.5e-6), (40, 1e-30)):
        heights = [logo.log_odds(k, n, p) for k in range(1, n + 1)]
        assert logo.cap(n, p) == max(h for h in heights if h != float("inf"))


def test_mates_keep_apart(spark):
    rows = [("h1", 99, "ref", 1, "4M2I4M", "ATCTGGTTAT"), ("h1", 147, "ref", 1, "8M", "CCCCCCCC")]
    df = spark.createDataFrame(rows, "header string, flag int, rname string, pos int, cigar string, seq string")
    t = SeqTable.from_df(df)
    assert {(r.read_id, r.seqs) for r in t.strings_with_insertions().collect()} == {("h1/1", "ATCTggTTAT"), ("h1/2", "CCCC--CCCC")}
    shown = t.with_insertions(quality=False).where("read_id = 'h1/1' and loc < 0").orderBy("loc").collect()
    assert [(r.position, r.loc, r.base) for r in shown] == [(5, -2, "g"), (5, -1, "g")]
