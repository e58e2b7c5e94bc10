"""Registered queries over derived reads, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import codon, scalar
from strandloom.operators import compare, samtools, simulate
from strandloom.operators.table import SeqTable, merge_tables
from strandloom.plans import derive
from strandloom.plans.derive import WT
from strandloom.schema import TableInfo
from strandloom.sources import text

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# DuckDB views of the derived reads.


def _reads(name="reads", table="orders", key="o_orderkey", extra=""):
    return f"""{name} AS (
  SELECT k, k AS read_id, list_aggregate(list_transform(range(1, 33), lambda p: CASE WHEN m[p] < 'c' THEN ('{WT}')[p] ELSE translate(m[p], 'cdef', 'ACGT') END), 'string_agg', '') AS seq,
         translate(q, '0123456789abcdef', '!#(-27:=?ADEFGHI') AS qual{extra}
  FROM (SELECT *, {key} AS k, md5({key}::VARCHAR) AS m, md5('q' || {key}::VARCHAR) AS q FROM {table}))"""


READS = _reads(extra=", o_totalprice AS weight")
READS2 = _reads("reads2", "customer", "c_custkey")
CELLS = "cells AS (SELECT k, read_id, weight, p::INT AS position, seq[p] AS base, ascii(qual[p]) - 33 AS q FROM reads, (SELECT unnest(range(1, 33)) AS p))"
BASE = f"WITH {READS}, {CELLS}"
COUNTS = f"{BASE}, n AS (SELECT position, base AS letter, count(*) AS value FROM cells GROUP BY ALL)"
FREQ = f"{COUNTS}, f AS (SELECT position, letter, value / sum(value) OVER (PARTITION BY position) AS value FROM n)"
REFS = _reads("refs0", "(SELECT unnest(range(1, 6)) AS r)", "r") + ", refs AS (SELECT row_number() OVER (ORDER BY k) AS ref_id, seq AS ref FROM refs0)"
MATCHES = f"{BASE}, {REFS}, m AS (SELECT read_id, ref_id, position, base AS a, ref[position] AS b FROM cells, refs)"
SAM = f"""{READS}, sam AS (
  SELECT read_id, k::VARCHAR AS header, [0, 16, 4, 99, 147, 512, 1024, 83][(k // 8) % 8 + 1] AS flag,
    CASE WHEN k % 50 = 0 THEN '*' WHEN k % 33 = 0 THEN 'phiX' ELSE 'ref' END AS rname, (1 + k % 5)::INT AS pos, (k % 61)::INT AS mapq,
    CASE WHEN k % 8 <= 4 THEN '32M' WHEN k % 8 = 5 THEN '10M2I20M' WHEN k % 8 = 6 THEN '12M3D20M' ELSE '4S28M' END AS cigar, seq, qual FROM reads)"""
# The walk over CIGAR operations as prefix sums: where each begins in the read and on the reference.
WALK = f"""WITH {SAM}, used AS (SELECT * FROM sam WHERE rname <> '*'),
op AS (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDS])', 1) AS ns, regexp_extract_all(cigar, '(\\d+)([MIDS])', 2) AS os FROM used),
ops AS (SELECT read_id, pos, seq, qual, unnest(range(1, len(ns) + 1)) AS i, ns, os FROM op),
step AS (SELECT read_id, pos, seq, qual, i, ns[i]::INT AS n, os[i] AS o,
  coalesce(sum(CASE WHEN os[i] IN ('M', 'I', 'S') THEN ns[i]::INT ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  pos + coalesce(sum(CASE WHEN os[i] IN ('M', 'D') THEN ns[i]::INT ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM ops),
bases AS (SELECT read_id, (r + j)::INT AS position, CASE WHEN o = 'M' THEN seq[(s + j + 1)::INT] ELSE '-' END AS base, CASE WHEN o = 'M' THEN qual[(s + j + 1)::INT] ELSE '!' END AS c
  FROM (SELECT *, unnest(range(0, n)) AS j FROM step WHERE o IN ('M', 'D'))),
ins AS (SELECT read_id, r::INT AS position, (j - n)::INT AS loc, seq[(s + j + 1)::INT] AS base, ascii(qual[(s + j + 1)::INT]) - 33 AS q
  FROM (SELECT *, unnest(range(0, n)) AS j FROM step WHERE o = 'I')),
ext AS (SELECT min(position) AS lo, max(position) AS hi FROM bases),
full_ AS (SELECT u.read_id, p.position, coalesce(b.base, '$') AS base, coalesce(b.c, '!') AS c
  FROM used u CROSS JOIN (SELECT unnest(range(lo, hi + 1))::INT AS position FROM ext) p LEFT JOIN bases b ON b.read_id = u.read_id AND b.position = p.position)"""


# Distributions.


def _dist(**options):
    positions = options.pop("positions", None)
    return lambda s, d: derive.reads(s, d).seq_dist(positions, **options)


query(f"{COUNTS} SELECT position, letter, value FROM n", "seq_dist_counts")(_dist())
query(f"{COUNTS} SELECT position, letter, value FROM n WHERE position IN (3, 4, 9)", "seq_dist_positions")(_dist(positions=[3, 4, 9]))
query(f"{FREQ} SELECT position, letter, round(value, 6) AS value FROM f", "seq_dist_freq")(lambda s, d: r6(derive.reads(s, d).seq_dist(method="freq"), "value"))
query(f"{BASE} SELECT position, base AS letter, round(sum(weight), 2) AS value FROM cells GROUP BY ALL", "seq_dist_weighted")(
    lambda s, d: derive.reads(s, d).seq_dist(weight="weight").withColumn("value", F.round("value", 2)))
query(f"{BASE}, n AS (SELECT position, base AS letter, count(*) AS v FROM cells WHERE base <> 'A' GROUP BY ALL) SELECT position, letter, round(v / sum(v) OVER (PARTITION BY position), 6) AS value FROM n", "seq_dist_ignore")(
    lambda s, d: r6(derive.reads(s, d).seq_dist(method="freq", ignore=["A"]), "value"))

_BITS = """, h AS (SELECT position, -sum(value * log2(value)) AS h FROM f GROUP BY position),
k AS (SELECT (SELECT count(DISTINCT letter) FROM f) AS s, (SELECT count(*) FROM reads) AS n)
SELECT position, letter, round(greatest(0, value * (log2(s) - (h + (s - 1) / (2 * n * ln(2)) / 2))), 6) AS value FROM f JOIN h USING (position), k"""
query(FREQ + _BITS, "seq_dist_bits")(lambda s, d: r6(derive.reads(s, d).seq_dist(method="bits"), "value"))
# Whole texts, in consecutive reads of 40 letters.
_AA_WHOLE = """WITH d AS (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', 'X', 'g') AS s FROM documents WHERE text IS NOT NULL),
reads AS (SELECT doc_id || ':' || i AS read_id, rpad(substr(s, i * 40 + 1, 40), 40, 'X') AS seq FROM (SELECT *, unnest(range(0, greatest(length(s) - 1, 0) // 40 + 1)) AS i FROM d)),
n AS (SELECT p::INT AS position, seq[p] AS letter, count(*) AS value FROM reads, (SELECT unnest(range(1, 41)) AS p) GROUP BY ALL), f AS (SELECT position, letter, value / sum(value) OVER (PARTITION BY position) AS value FROM n)"""
query(_AA_WHOLE + _BITS, "seq_dist_bits_aa")(lambda s, d: r6(derive.amino_pieces(s, d).seq_dist(method="bits"), "value"))
query(f"""{WALK} SELECT position, base AS letter, count(*) AS value FROM full_ GROUP BY ALL UNION ALL SELECT position, '^', count(*) FROM ins WHERE loc = -1 GROUP BY position""", "seq_dist_insertion_row")(
    lambda s, d: derive.projected(s, d).seq_dist(insertions=True))
query(f"{FREQ} SELECT position, round(-sum(value * log2(value)), 6) AS entropy FROM f GROUP BY position", "pos_entropy")(lambda s, d: r6(derive.reads(s, d).pos_entropy(), "entropy"))
query(f"{FREQ} SELECT position, round(-sum(value * ln(value)) / ln(4), 6) AS entropy FROM f GROUP BY position", "pos_entropy_base4")(lambda s, d: r6(derive.reads(s, d).pos_entropy(base=4), "entropy"))
query(f"{FREQ} SELECT position, round(exp(-sum(value * ln(value))), 6) AS diversity FROM f GROUP BY position", "diversity")(lambda s, d: r6(derive.reads(s, d).diversity(), "diversity"))
query(f"{FREQ} SELECT position, round(sum(value * ln(value / 0.25)), 6) AS relative_entropy FROM f GROUP BY position", "relative_entropy_uniform")(
    lambda s, d: r6(derive.reads(s, d).relative_entropy(), "relative_entropy"))
query(f"""{FREQ}, {READS2}, g0 AS (SELECT position, letter, count(*) AS c FROM (SELECT p::INT AS position, seq[p] AS letter FROM reads2, (SELECT unnest(range(1, 33)) AS p)) GROUP BY ALL), g AS (SELECT position, letter, c / sum(c) OVER (PARTITION BY position) AS b FROM g0)
SELECT position, round(sum(value * ln(value / b)), 6) AS relative_entropy FROM f JOIN g USING (position, letter) GROUP BY position""", "relative_entropy_background")(
    lambda s, d: r6(derive.reads(s, d).relative_entropy(derive.reads2(s, d, first=1)), "relative_entropy"))

_CONS = """, t AS (SELECT position, max(value) AS m, sum(value) AS s, arg_max(letter, value * 1000 - ascii(letter)) AS l FROM n GROUP BY position)
SELECT string_agg(CASE WHEN m <= s * {cut} THEN 'N' ELSE l END, '' ORDER BY position) AS consensus FROM t"""
query(COUNTS + _CONS.format(cut=0.5), "consensus")(lambda s, d: derive.reads(s, d).consensus())
query(COUNTS + _CONS.format(cut=0.83), "consensus_strict")(lambda s, d: derive.reads(s, d).consensus(cutoff=0.83))
query(f"""{WALK}, n AS (SELECT position, 0 AS loc, base AS letter, count(*) AS value FROM full_ GROUP BY ALL),
i AS (SELECT position, loc, base AS letter, count(*) AS value FROM ins GROUP BY ALL),
g AS (SELECT position, loc, '-' AS letter, (SELECT count(*) FROM used) - sum(value) AS value FROM i GROUP BY position, loc),
al AS (SELECT * FROM n UNION ALL SELECT * FROM i UNION ALL SELECT * FROM g),
t AS (SELECT position, loc, max(value) AS m, sum(value) AS s, arg_max(letter, value * 1000 - ascii(letter)) AS l FROM al GROUP BY ALL),
c AS (SELECT position, loc, CASE WHEN m <= s * 0.5 THEN 'N' ELSE l END AS l FROM t)
SELECT string_agg(l, '' ORDER BY position, loc) AS consensus FROM c WHERE loc = 0 OR l <> '-'""", "consensus_with_insertions")(lambda s, d: derive.projected(s, d).consensus())


# Comparisons.

query(f"{MATCHES} SELECT read_id, ref_id, position, a = b AS is_match FROM m WHERE position <= 6", "compare_match_long")(
    lambda s, d: derive.reads(s, d).compare_to_references(derive.references(s, d), list(range(1, 7))))
query(f"""{MATCHES} SELECT read_id, ref_id, position, CASE WHEN a IN ('C', 'G') OR b IN ('C', 'G') THEN NULL ELSE NOT (a = b OR a IN ('A') OR b IN ('A')) END AS is_match FROM m WHERE position <= 4""", "compare_ignore_chars")(
    lambda s, d: derive.reads(s, d).compare_to_references(derive.references(s, d), [1, 2, 3, 4], flip=True, ignore=["C", "G"], treat=["A"]))
query(f"{MATCHES} SELECT read_id, ref_id, position, a = b AS is_match FROM m WHERE position > 28", "compare_set_diff")(
    lambda s, d: derive.reads(s, d).compare_to_references(derive.references(s, d), list(range(1, 29)), set_diff=True))
query(f"{MATCHES} SELECT ref_id, position, round(avg((a = b)::INT), 6) AS match_rate, round(1 - avg((a = b)::INT), 6) AS error_rate FROM m GROUP BY ALL", "error_rate_by_position")(
    lambda s, d: r6(compare.error_rate(*_pair(derive.reads(s, d)), derive.references(s, d)), "match_rate", "error_rate"))
query(f"{MATCHES} SELECT read_id, ref_id, sum((a <> b)::INT)::BIGINT AS distance FROM m GROUP BY ALL", "hamming_refs")(lambda s, d: derive.reads(s, d).hamming_distance(derive.references(s, d)))
query(f"{MATCHES} SELECT read_id, ref_id, round(avg(CASE WHEN a <> 'A' AND b <> 'A' THEN (a <> b)::INT END), 6) AS distance FROM m GROUP BY ALL", "hamming_normalized")(
    lambda s, d: r6(derive.reads(s, d).hamming_distance(derive.references(s, d), normalized=True, ignore=["A"]), "distance"))
query(f"{MATCHES} SELECT read_id, ref_id, sum((a <> b AND a NOT IN ('A', 'G') AND b NOT IN ('A', 'G'))::INT)::BIGINT AS distance FROM m GROUP BY ALL", "hamming_treat_as_match")(
    lambda s, d: derive.reads(s, d).hamming_distance(derive.references(s, d), treat=["A", "G"]))
query(f"""WITH {_reads('a', 'supplier', 's_suppkey')}, x AS (SELECT k, p, seq[p] AS c FROM a, (SELECT unnest(range(1, 33)) AS p))
SELECT l.k AS read_id, r.k AS other_id, sum((l.c <> r.c)::INT)::BIGINT AS distance FROM x l JOIN x r USING (p) GROUP BY ALL""", "pairwise_hamming")(
    lambda s, d: compare.pairwise(*_pair(_suppliers(s, d)), _suppliers(s, d).df))


def _pair(t: SeqTable):
    return t.df, t.info


def _suppliers(s, d):
    return SeqTable(derive.keyed(derive.table(s, d, "supplier"), "s_suppkey"), TableInfo(first=1, last=32))


_PWM = [[0.1 + ((p * 7 + i * 3) % 11) / 10 for i in range(4)] for p in range(32)]
_PWM_SQL = f"{BASE}, w AS (SELECT read_id, {[[round(x, 1) for x in row] for row in _PWM]}[position][instr('ACGT', base)] AS w FROM cells)"
_PWM = [[round(x, 1) for x in row] for row in _PWM]
query(f"{_PWM_SQL} SELECT read_id, round(ln(product(w)), 6) AS score FROM w GROUP BY read_id", "pwm_product")(lambda s, d: derive.reads(s, d).pwm(_PWM).withColumn("score", F.round(F.ln("score"), 6)))
query(f"{_PWM_SQL} SELECT read_id, round(sum(w), 6) AS score FROM w GROUP BY read_id", "pwm_sum")(lambda s, d: r6(derive.reads(s, d).pwm(_PWM, product=False), "score"))
_MUT = f"""{COUNTS}, {REFS}, grid AS (SELECT position, letter FROM (SELECT DISTINCT position FROM n), (SELECT DISTINCT letter FROM n)),
d AS (SELECT g.position, g.letter AS read_base, coalesce(n.value, 0) AS v FROM grid g LEFT JOIN n USING (position, letter)),
mu AS (SELECT ref_id, position, ref[position] AS ref_base, read_base, v FROM d, refs)"""
query(f"{_MUT} SELECT ref_id, ref_base, read_base, sum(v)::BIGINT AS value FROM mu WHERE ref_base <> read_base GROUP BY ALL", "mutation_profile")(lambda s, d: derive.reads(s, d).mutation_profile(derive.references(s, d)))
query(f"{_MUT} SELECT ref_id, position, ref_base, read_base, sum(v)::BIGINT AS value FROM mu WHERE ref_base <> read_base GROUP BY ALL", "mutation_profile_by_position")(
    lambda s, d: derive.reads(s, d).mutation_profile(derive.references(s, d), by_position=True))
query(f"{_MUT}, t AS (SELECT *, sum(v) OVER (PARTITION BY ref_id) AS s FROM mu) SELECT ref_id, ref_base, read_base, round(sum(v) / max(s), 6) AS value FROM t WHERE ref_base <> read_base GROUP BY ALL", "mutation_profile_normalized")(
    lambda s, d: r6(derive.reads(s, d).mutation_profile(derive.references(s, d), normalized=True), "value"))
_TS = ", z AS (SELECT *, ref_base || read_base IN ('AG', 'GA', 'CT', 'TC') AS ts FROM mu WHERE ref_base <> read_base)"
query(f"{_MUT}{_TS} SELECT ref_id, round(sum(v) FILTER (ts) / sum(v) FILTER (NOT ts), 6) AS ratio, round(sum(v) FILTER (ts) / sum(v), 6) AS ts, round(sum(v) FILTER (NOT ts) / sum(v), 6) AS tv FROM z GROUP BY ref_id", "ts_tv")(
    lambda s, d: r6(derive.reads(s, d).ts_tv_profile(derive.references(s, d)), "ratio", "ts", "tv"))
query(f"""{_MUT}{_TS} SELECT ref_id, position, round(sum(v) FILTER (ts) / nullif(sum(v) FILTER (NOT ts), 0), 6) AS ratio, coalesce(round(sum(v) FILTER (ts) / nullif(sum(v), 0), 6), 0) AS ts,
coalesce(round(sum(v) FILTER (NOT ts) / nullif(sum(v), 0), 6), 0) AS tv FROM z GROUP BY ref_id, position""", "ts_tv_by_position")(
    lambda s, d: r6(derive.reads(s, d).ts_tv_profile(derive.references(s, d), by_position=True), "ratio", "ts", "tv"))


# Slices and words.

query(f"WITH {READS} SELECT read_id, seq[9] || seq[2] || seq[3] || seq[4] AS seqs, qual[9] || qual[2] || qual[3] || qual[4] AS quals FROM reads", "slice_positions")(
    lambda s, d: derive.reads(s, d).slices([9, 2, 3, 4, 2], with_quality=True))
query(f"WITH {READS} SELECT read_id, 'NN' || seq[1:3] || 'N' AS seqs, '!!' || qual[1:3] || '!' AS quals FROM reads", "slice_padded")(
    lambda s, d: derive.reads(s, d).slices([-1, 0, 1, 2, 3, 40], with_quality=True))
query(f"""{WALK}, col AS (SELECT position, loc FROM ins GROUP BY ALL),
v AS (SELECT read_id, position, 0 AS loc, base FROM full_ UNION ALL SELECT u.read_id, c.position, c.loc, coalesce(lower(i.base), '-') FROM used u CROSS JOIN col c LEFT JOIN ins i ON i.read_id = u.read_id AND i.position = c.position AND i.loc = c.loc)
SELECT read_id, string_agg(base, '' ORDER BY position, loc) AS seqs FROM v GROUP BY read_id""", "slice_with_insertions")(lambda s, d: derive.projected(s, d).strings_with_insertions())
query(f"{BASE} SELECT base, count(*) AS n, sum(q)::BIGINT AS q FROM cells GROUP BY base", "quality_numeric")(
    lambda s, d: derive.reads(s, d).cells(quality=True).groupBy("base").agg(F.count("*").alias("n"), F.sum("q").alias("q")))
query(f"{BASE}, w AS (SELECT k, a, b FROM (SELECT k, seq, a, b FROM reads, (SELECT unnest(range(1, 8)) AS a), (SELECT unnest(range(1, 8)) AS b) WHERE a < b)) SELECT a::INT AS p1, b::INT AS p2, seq[a] || seq[b] AS word, count(*) AS value FROM w JOIN reads USING (k) GROUP BY ALL", "substrings_k2")(
    lambda s, d: derive.reads(s, d).substrings(2, list(range(1, 8))).select(F.col("positions")[0].alias("p1"), F.col("positions")[1].alias("p2"), "word", "value"))
query(f"WITH {READS} SELECT seq[1:3] AS word, round(sum(weight), 2) AS value FROM reads GROUP BY ALL", "substrings_weighted")(
    lambda s, d: derive.reads(s, d).substrings(3, [1, 2, 3], weight="weight").select("word", F.round("value", 2).alias("value")))
query(f"""{WALK}, col AS (SELECT position, loc FROM ins GROUP BY ALL),
v AS (SELECT read_id, position, 0 AS loc, base FROM full_ WHERE position IN (11, 12) UNION ALL
SELECT u.read_id, c.position, c.loc, coalesce(lower(i.base), '-') FROM used u CROSS JOIN col c LEFT JOIN ins i ON i.read_id = u.read_id AND i.position = c.position AND i.loc = c.loc WHERE c.position IN (11, 12))
SELECT a.position AS p1, a.loc AS l1, b.position AS p2, b.loc AS l2, a.base || b.base AS word, count(*) AS value FROM v a JOIN v b ON a.read_id = b.read_id AND (a.position, a.loc) < (b.position, b.loc) GROUP BY ALL""", "substrings_with_insertions")(
    lambda s, d: derive.projected(s, d).substrings(2, [11, 12], with_insertions=True).select(
        F.col("positions")[0]["position"].alias("p1"), F.col("positions")[0]["loc"].alias("l1"), F.col("positions")[1]["position"].alias("p2"), F.col("positions")[1]["loc"].alias("l2"), "word", "value"))
query(f"WITH {READS} SELECT read_id, [[(seq[p] = 'A')::INT, (seq[p] = 'C')::INT, (seq[p] = 'G')::INT, (seq[p] = 'T')::INT] for p in range(1, 33)]::VARCHAR AS one_hot FROM reads", "one_hot")(
    lambda s, d: derive.reads(s, d).one_hot().withColumn("one_hot", F.concat(F.lit("["), F.array_join(F.transform("one_hot", lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))), ", "), F.lit("]"))))
query(f"WITH {READS}, s AS (SELECT read_id, seq[1:4] AS seq FROM reads) SELECT read_id, seq FROM s WHERE seq IN (SELECT seq FROM s GROUP BY seq HAVING count(*) > 40)", "filter_by_count")(
    lambda s, d: derive.reads(s, d).window(1, 4).repeated_reads(40).sequences())


# Quality.

query(f"{BASE} SELECT read_id FROM cells GROUP BY read_id HAVING 100 * count(*) FILTER (q >= 20) >= 70 * count(*) FILTER (q > 0)", "quality_filter")(lambda s, d: derive.reads(s, d).quality_filter(20, 70).df.select("read_id"))
query(f"{BASE} SELECT read_id, string_agg(CASE WHEN q < 20 AND q > 0 THEN 'N' ELSE base END, '' ORDER BY position) AS seq FROM cells GROUP BY read_id", "mask_low_quality")(lambda s, d: derive.reads(s, d).low_bases_to_null(20).sequences())


def _bins(pairs):
    values = ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in pairs)
    return f"""{BASE}, bins(bin, lo, hi) AS (VALUES {values}), c AS (SELECT bin, q FROM cells JOIN bins ON position BETWEEN lo AND hi WHERE q > 0)
SELECT bin, {', '.join(f'round(quantile_cont(q, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90))}, round(avg(q), 6) AS mean, round(median(q), 6) AS median, min(q)::DOUBLE AS min, max(q)::DOUBLE AS max FROM c GROUP BY bin"""


_QCOLS = ("p10", "p25", "p50", "p75", "p90", "mean", "median")
query(_bins([(i, min(i + 2, 32)) for i in range(1, 33, 3)]), "quality_bins_even")(lambda s, d: r6(derive.reads(s, d).quality_dist("even"), *_QCOLS))
query(_bins([(p, p) for p in range(1, 10)] + [(p, p + 4) for p in range(10, 33, 5)]), "quality_bins_fastqc")(lambda s, d: r6(derive.reads(s, d).quality_dist("fastqc"), *_QCOLS))
query(_bins([(1, 8), (9, 9), (20, 32)]), "quality_bins_custom")(lambda s, d: r6(derive.reads(s, d).quality_dist([(1, 8), 9, (20, 32)]), *_QCOLS))


# Projection and insertions.

query(f"{WALK} SELECT read_id, string_agg(base, '' ORDER BY position) AS seq, string_agg(c, '' ORDER BY position) AS qual FROM full_ GROUP BY read_id", "cigar_project")(
    lambda s, d: derive.projected(s, d).df.select("read_id", "seq", "qual"))
query(f"{WALK} SELECT read_id, string_agg(base, '' ORDER BY position) AS seq, string_agg(c, '' ORDER BY position) AS qual FROM full_ WHERE position BETWEEN 8 AND 20 GROUP BY read_id", "cigar_project_window")(
    lambda s, d: derive.projected(s, d, 8, 20).df.select("read_id", "seq", "qual"))
query(f"WITH {SAM} SELECT read_id, substr(rpad(repeat('$', pos - 1) || seq, 36, '$'), 3, 30) AS seq FROM sam WHERE rname <> '*'", "trim_pad_no_cigar")(
    lambda s, d: SeqTable.from_df(derive.sam(s, d).drop("cigar"), index="read_id", first=3, last=32).sequences())
query(f"{WALK} SELECT position, count(*) AS reads FROM ins WHERE loc = -1 GROUP BY position", "insertion_events")(lambda s, d: derive.projected(s, d).insertion_events())
query(f"{WALK} SELECT position, loc, count(*) AS n FROM ins WHERE q >= 20 GROUP BY ALL", "insertion_distribution")(lambda s, d: derive.projected(s, d).insertion_distribution(least_quality=20))
query(f"{WALK} SELECT position, loc, round(avg(q), 6) AS q FROM ins GROUP BY ALL", "insertion_avg_quality")(lambda s, d: r6(derive.projected(s, d).average_insertion_quality(), "q"))
for _m, _e in (("mean", "avg(loc)"), ("median", "median(loc)"), ("max", "min(loc)::DOUBLE")):
    query(f"{WALK} SELECT position, round({_e}, 6) AS loc FROM ins GROUP BY position", f"insertion_expect_{_m}")(lambda s, d, m=_m: r6(derive.projected(s, d).insertion_expectations(method=m), "loc"))
query(f"""{WALK}, i AS (SELECT position, loc, base AS letter, count(*) AS value FROM ins GROUP BY ALL)
SELECT * FROM i UNION ALL SELECT position, loc, '-', ((SELECT count(*) FROM used) - sum(value))::BIGINT FROM i GROUP BY position, loc""", "insertion_seq_dist")(lambda s, d: derive.projected(s, d).insertion_seq_dist())
query(f"""{WALK}, col AS (SELECT position, loc FROM ins GROUP BY ALL), v AS (SELECT position, 0 AS loc, base FROM full_ UNION ALL
SELECT c.position, c.loc, coalesce(lower(i.base), '-') FROM used u CROSS JOIN col c LEFT JOIN ins i ON i.read_id = u.read_id AND i.position = c.position AND i.loc = c.loc)
SELECT position, loc, base, count(*) AS n FROM v GROUP BY ALL""", "insertion_view")(lambda s, d: derive.projected(s, d).with_insertions().groupBy("position", "loc", "base").agg(F.count("*").alias("n")))


# Merging.

_MERGED = f"WITH {READS}, {READS2}, a AS (SELECT seq || '----' AS seq, qual || '!!!!' AS qual, row_number() OVER (ORDER BY k) AS read_id, k FROM reads), b AS (SELECT '----' || seq AS seq, '!!!!' || qual AS qual, k FROM reads2)"
query(f"{_MERGED} SELECT read_id, seq, qual FROM a UNION ALL SELECT (SELECT count(*) FROM reads) + row_number() OVER (ORDER BY k), seq, qual FROM b", "merge_axis0")(
    lambda s, d: merge_tables([derive.reads(s, d), derive.reads2(s, d)]).df.select("read_id", "seq", "qual"))
query(f"{_MERGED} SELECT coalesce(a.k, b.k) AS read_id, CASE WHEN b.k IS NULL THEN a.seq WHEN a.k IS NULL THEN b.seq ELSE a.seq[1:4] || b.seq[5:36] END AS seq FROM a FULL JOIN b ON a.k = b.k", "merge_axis1")(
    lambda s, d: merge_tables([derive.reads(s, d), derive.reads2(s, d)], axis=1).df.select("read_id", "seq"))


# Alignment records.

_REASON = """CASE WHEN rname IN ('', '*') THEN 'invalid_hit' WHEN lower(rname) LIKE 'phix%' THEN 'phix' WHEN flag & 516 <> 0 THEN 'flag' WHEN regexp_matches(cigar, '[ID]') THEN 'indel' WHEN regexp_matches(cigar, '[HP=XN]') THEN 'cigar' END"""
query(f"""WITH {SAM} SELECT header, flag, CASE WHEN flag & 16 = 0 THEN 'R1' ELSE 'R2' END AS read, CASE WHEN cigar LIKE '4S%' THEN 4 ELSE 0 END AS nterminal_clip, 0 AS cterminal_clip,
pos + 32 - CASE WHEN cigar LIKE '4S%' THEN 4 ELSE 0 END - 1 AS pos_end FROM sam WHERE ({_REASON}) IS NULL""", "sam_filter_good")(
    lambda s, d: samtools.filtered(derive.sam(s, d))[0].select("header", "flag", "read", "nterminal_clip", "cterminal_clip", "pos_end"))
query(f"WITH {SAM} SELECT coalesce({_REASON}, 'good') AS reason, count(*) AS reads FROM sam GROUP BY ALL", "sam_filter_stats")(lambda s, d: samtools.filtered(derive.sam(s, d))[2])
query(f"WITH {SAM} SELECT header, array_to_string(list_filter(range(0, 12), lambda i: (flag >> i::INT) & 1 = 1), ',') AS bits, CASE WHEN flag & 16 = 0 THEN 'R1' ELSE 'R2' END AS read FROM sam", "flag_bits")(
    lambda s, d: derive.sam(s, d).select("header", scalar.flag_text("flag").alias("bits"), scalar.read_number("flag").alias("read")))
query(f"""WITH {SAM} SELECT cigar, coalesce(nullif(regexp_extract(cigar, '^(\\d+)S', 1), '')::INT, 0) AS lead, coalesce(nullif(regexp_extract(cigar, '(\\d+)S$', 1), '')::INT, 0) AS trail,
regexp_extract(cigar, '(\\d+)M', 1)::INT AS hits, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[DN]', 1), lambda x: x::INT)), 0)::INT AS gaps, count(*) AS n FROM sam GROUP BY ALL""", "cigar_totals")(
    lambda s, d: derive.sam(s, d).groupBy("cigar", scalar.leading_clip("cigar").alias("lead"), scalar.trailing_clip("cigar").alias("trail"), scalar.base_hits("cigar").alias("hits"),
                                                                scalar.cigar_total("cigar", "DN").alias("gaps")).agg(F.count("*").alias("n")))
query(f"WITH {SAM}, f AS (SELECT rname, (flag & 4 = 0) AS up FROM sam) SELECT rname, count(*) FILTER (up) AS mapped, count(*) FILTER (NOT up) AS unmapped FROM f GROUP BY rname", "idxstats")(lambda s, d: samtools.idxstats(derive.sam(s, d)))
query(f"""WITH {SAM}, m(metric, need, hide) AS (VALUES ('total', 0, 0), ('secondary', 256, 0), ('supplementary', 2048, 256), ('duplicates', 1024, 0), ('mapped', 0, 4), ('paired', 1, 2304), ('read1', 65, 2304), ('read2', 129, 2304),
('properly_paired', 3, 2308), ('with_mate_mapped', 1, 2316), ('singletons', 9, 2308), ('mate_elsewhere', 1 << 20, 0), ('mate_elsewhere_mapq5', 1 << 20, 0))
SELECT metric, count(*) FILTER (flag & 512 = 0 AND flag & need = need AND flag & hide = 0) AS passed, count(*) FILTER (flag & 512 <> 0 AND flag & need = need AND flag & hide = 0) AS failed FROM sam, m GROUP BY metric""", "flagstat")(
    lambda s, d: samtools.flagstat(derive.sam(s, d)))
_DEEP = WALK.replace("WHERE rname <> '*'", "WHERE flag & 1796 = 0")
query(f"{_DEEP}, x AS (SELECT read_id, position FROM bases WHERE base <> '-') SELECT rname, position, count(*) AS depth FROM x JOIN used USING (read_id) GROUP BY ALL", "depth")(lambda s, d: samtools.depth(derive.sam(s, d)))
query(f"""{_DEEP}, x AS (SELECT read_id, position FROM bases WHERE base <> '-'), reg(rname, start, stop) AS (VALUES ('ref', 3, 9), ('ref', 20, 60), ('phiX', 1, 5), ('none', 1, 5))
SELECT reg.rname, start, stop, count(y.position) AS bases FROM reg LEFT JOIN (SELECT rname, position FROM x JOIN used USING (read_id)) y ON y.rname = reg.rname AND y.position >= start AND y.position < stop GROUP BY ALL""", "bed_coverage")(
    lambda s, d: samtools.bed_coverage(derive.sam(s, d), s.createDataFrame([("ref", 3, 9), ("ref", 20, 60), ("phiX", 1, 5), ("none", 1, 5)], "rname string, start int, stop int"), 16))
query(f"WITH {SAM}, n AS (SELECT header, rname, pos, mapq, row_number() OVER (PARTITION BY rname, pos, flag & 16 ORDER BY mapq DESC, header) AS i FROM sam) SELECT header, rname, pos, mapq FROM n WHERE i = 1", "rmdup")(
    lambda s, d: samtools.without_duplicates(derive.sam(s, d)).select("header", "rname", "pos", "mapq"))


query(f"WITH {SAM} SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT header::BIGINT FROM sam WHERE flag & 4 = 0)", "unaligned_reads")(
    lambda s, d: samtools.unaligned(derive.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("header")), derive.sam(s, d)).select(F.col("header").cast("long").alias("k")))
query(f"""{WALK.replace("WHERE rname <> '*'", "WHERE true")}, w AS (SELECT '{WT * 2}' AS r) SELECT read_id, (coalesce(sum((base <> r[position])::INT), 0) + coalesce(any_value(i.n), 0))::INT AS nm
FROM bases JOIN w ON true LEFT JOIN (SELECT read_id, count(*) AS n FROM ins GROUP BY read_id) i USING (read_id) GROUP BY read_id""", "mismatch_tag")(
    lambda s, d: samtools.mismatch_tag(derive.sam(s, d), WT * 2).select("read_id", "nm"))


# Codons.

# The standard code, written out in the order TCAG; codons with N stand for several residues here.
_RESIDUE = """CASE WHEN instr(x, 'N') > 0 THEN 'X' ELSE substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
16 * (instr('TCAG', x[1]) - 1) + 4 * (instr('TCAG', x[2]) - 1) + instr('TCAG', x[3]), 1) END"""


def _codon_sql(frame, pad):
    s = f"seq[{frame + 1}:]" + (f" || repeat('N', (3 - (32 - {frame}) % 3) % 3)" if pad else "")
    return f"WITH {READS}, c AS (SELECT read_id, {s} AS s FROM reads), l AS (SELECT read_id, list_transform(range(0, length(s) // 3), lambda i: s[i * 3 + 1:i * 3 + 3]) AS codons FROM c)"


query(f"{_codon_sql(0, False)} SELECT read_id, array_to_string(list_transform(codons, lambda x: {_RESIDUE}), '') AS protein FROM l", "translate_frame0")(lambda s, d: derive.reads(s, d).df.select("read_id", codon.translate("seq").alias("protein")))
query(f"{_codon_sql(1, True)} SELECT read_id, array_to_string(list_transform(codons, lambda x: {_RESIDUE}), '') AS protein FROM l", "translate_pad")(
    lambda s, d: derive.reads(s, d).df.select("read_id", codon.translate("seq", 1, True).alias("protein")))
query(f"{_codon_sql(2, False)} SELECT read_id, array_to_string(codons, ' ') AS codons FROM l", "codons")(lambda s, d: derive.reads(s, d).df.select("read_id", F.array_join(codon.codons("seq", 2), " ").alias("codons")))
query("SELECT o_orderkey AS k, (o_orderkey + 6) // 3 + 1 AS residue, o_orderkey + 7 AS nt_pos, (o_orderkey + 6) % 3 AS codon_offset FROM (SELECT o_orderkey - 1 AS x, o_orderkey FROM orders)", "nt_to_residue")(
    lambda s, d: derive.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), codon.residue_number(F.col("o_orderkey") + 1, 3).alias("r")).select("k", "r.residue", "r.nt_pos", "r.codon_offset"))


# Logos.

query(f"""{FREQ} SELECT position, 0 AS loc, letter, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY position ORDER BY value, letter ROWS UNBOUNDED PRECEDING), 6) AS y_top, value > 0.09 AS labelled FROM f""", "logo_bars")(
    lambda s, d: r6(derive.reads(s, d).seq_logo(), "value", "y_top"))
query(f"""{COUNTS}, g AS (SELECT position, letter, value AS k, sum(value) OVER (PARTITION BY position)::BIGINT AS n FROM n),
x AS (SELECT position, letter, k, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75) AS l FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM g)),
t AS (SELECT position, letter, max(l) FILTER (i >= k) AS a, max(l) FILTER (i <= k) AS b FROM x GROUP BY ALL),
u AS (SELECT position, letter, a + ln(sum(exp(l - a)) FILTER (i >= k)) AS above, b + ln(sum(exp(l - b)) FILTER (i <= k)) AS below FROM x JOIN t USING (position, letter) GROUP BY position, letter, a, b)
SELECT position, letter, round((below - above) / ln(10), 3) AS log_odds FROM u""", "plogo")(lambda s, d: derive.reads(s, d).plogo(exact=True)[0].withColumn("log_odds", F.round("log_odds", 3)))
query(f"{COUNTS} SELECT round(-log10((0.01 / c) / (1 - 0.01 / c)), 6) AS height FROM (SELECT count(DISTINCT position) * count(DISTINCT letter) AS c FROM n)", "plogo_significance")(
    lambda s, d: s.createDataFrame([(round(derive.reads(s, d).plogo()[1], 6),)], "height double"))
query(f"WITH {READS} SELECT CASE WHEN bool_and(regexp_matches(seq, '^[ACGT$-]*$')) THEN 'NT' ELSE 'AA' END AS seq_type FROM reads", "guess_seqtype")(
    lambda s, d: s.createDataFrame([(_guess(derive.reads(s, d)),)], "seq_type string"))


def _guess(t):
    from strandloom.operators.align import guess_type

    return guess_type(t.df)


# Random operators: what must hold whatever was drawn.


@query("SELECT 100 AS n, 100 AS distinct_reads, 0 AS unknown")
def subsample(s, d):
    t = derive.reads(s, d)
    got = t.subsample(100, seed=3).sequences().join(t.df.select("read_id", F.col("seq").alias("known")), "read_id", "left")
    return got.agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("distinct_reads"), F.count_if(~F.col("seq").eqNullSafe(F.col("known"))).alias("unknown"))


@query("SELECT 1000 AS n, 0 AS odd_lengths, 0 AS odd_letters, 0 AS odd_site_4, 0 AS odd_site_9, true AS near_wild_type")
def generate_library(s, d):
    """Sites 4 and 9 are saturated with R and with A or C; elsewhere 2 % of the letters differ."""
    made = simulate.qualities(simulate.library(s, WT, 1000, saturated=[4, 9], codes={4: "R", 9: [("A", 3.0), ("C", 1.0)]}, error_rate=0.0))
    errors = simulate.library(s, WT, 1000, saturated=[], codes={}, error_rate=0.02)
    off = F.size(F.filter(F.zip_with(scalar.letters("seq"), scalar.letters(F.lit(WT)), lambda x, w: x != w), lambda v: v))
    rate = errors.agg(F.avg(off / len(WT)).alias("r")).select((F.abs(F.col("r") - 0.02) < 0.006).alias("near_wild_type"))
    site = lambda i: F.substring("seq", i, 1)
    return made.agg(F.count("*").alias("n"), F.count_if((F.length("seq") != 32) | (F.length("qual") != 32)).alias("odd_lengths"), F.count_if(~F.col("seq").rlike("^[ACGT]*$")).alias("odd_letters"),
                    F.count_if(~site(4).isin("A", "G")).alias("odd_site_4"), F.count_if(~site(9).isin("A", "C")).alias("odd_site_9")).crossJoin(F.broadcast(rate))  # one row each


# Files.


@query(f"WITH {READS} SELECT k AS read_ord, seq, qual FROM reads")
def fastq_roundtrip(s, d):
    df = derive.reads(s, d).df.withColumn("header", F.col("read_id").cast("string"))
    path = derive.saved(s, "fastq", lambda p: text.write_fastq(df, p))
    return text.read_fastq(s, path).select(F.col("header").cast("long").alias("read_ord"), "seq", "qual")


@query(f"WITH {READS} SELECT k AS id, seq FROM reads")
def fasta_roundtrip(s, d):
    record = F.concat(F.lit(">"), "read_id", F.lit(" a description\n"), F.substring("seq", 1, 20), F.lit("\n"), F.lower(F.substring("seq", 21, 20)))
    path = derive.saved(s, "fasta", lambda p: derive.reads(s, d).df.select(record).write.text(p))
    return text.read_fasta(s, path).select(F.col("id").cast("long").alias("id"), "seq")


def _sam_file(s, d):
    tagged = derive.sam(s, d).withColumn("tags", F.create_map(F.lit("XK"), F.concat(F.lit("a:"), F.col("read_id") % 3), F.lit("XL"), F.lit("z")))
    return derive.saved(s, "sam", lambda p: text.write_sam(tagged, p))


@query(f"WITH {SAM} SELECT header, flag, rname, pos, mapq, cigar, seq, qual, 'a:' || (k % 3) AS \"XK\" FROM (SELECT *, read_id AS k FROM sam)")
def sam_roundtrip(s, d):
    return text.read_sam(s, _sam_file(s, d), tags=["XK"]).select("header", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "XK")


@query("SELECT 50 AS n")
def sam_row_limit(s, d):
    return text.read_sam(s, _sam_file(s, d), rows=50).agg(F.count("*").alias("n"))


_REGION = """WHERE rname = 'ref' AND mapq >= 20 AND pos <= 60 AND pos + CASE cigar WHEN '10M2I20M' THEN 30 WHEN '12M3D20M' THEN 35 WHEN '4S28M' THEN 28 ELSE 32 END - 1 >= 35"""


@query(f"""{WALK.replace("WHERE rname <> '*'", _REGION)}, h AS (SELECT read_id, header || CASE WHEN flag & 1 = 0 THEN '' WHEN flag & 64 <> 0 THEN '/1' ELSE '/2' END AS name FROM sam)
SELECT h.name AS read_id, string_agg(base, '' ORDER BY position) AS seq FROM full_ JOIN h USING (read_id) GROUP BY h.name""")
def sam_region(s, d):
    """Reads of a file that overlap a region, though they begin before it."""
    return SeqTable.from_sam(s, _sam_file(s, d), least_mapq=20, region=("ref", 35, 60)).sequences()


@query("SELECT * FROM (VALUES (1, 'ACGTN', '!!!!!'), (2, 'ACNNN', 'II!!!'), (3, 'ACGTA', 'ABCDE')) AS t(read_id, seq, qual)")
def from_list_ragged(s, d):
    return SeqTable.from_list(s, ["acgt", "AC", "ACGTA"], ["!!!!", "II", "ABCDE"], seq_type="NT").df.select(F.col("read_id").cast("int").alias("read_id"), "seq", "qual")


# Mates.

_MATES = WALK.replace("used AS (SELECT * FROM sam WHERE rname <> '*')", "used AS (SELECT * REPLACE ((read_id - read_id % 2) || CASE WHEN read_id % 2 = 0 THEN '/1' ELSE '/2' END AS read_id) FROM sam WHERE rname <> '*')")
query(f"""{_MATES}, col AS (SELECT position, loc FROM ins GROUP BY ALL),
v AS (SELECT read_id, position, 0 AS loc, base FROM full_ UNION ALL SELECT u.read_id, c.position, c.loc, coalesce(lower(i.base), '-') FROM used u CROSS JOIN col c LEFT JOIN ins i ON i.read_id = u.read_id AND i.position = c.position AND i.loc = c.loc)
SELECT read_id, string_agg(base, '' ORDER BY position, loc) AS seqs FROM v GROUP BY read_id""", "mates_with_insertions")(lambda s, d: SeqTable.from_df(derive.paired(s, d).drop("read_id")).strings_with_insertions())
_PAIRS = f"WITH {SAM}, p AS (SELECT *, read_id - read_id % 2 AS h, read_id % 2 AS r, pos + CASE cigar WHEN '10M2I20M' THEN 30 WHEN '12M3D20M' THEN 35 WHEN '4S28M' THEN 28 ELSE 32 END - 1 AS e FROM sam)"
query(f"{_PAIRS} SELECT h::VARCHAR AS header, max(seq) FILTER (r = 0) AS seq1, max(seq) FILTER (r = 1) AS seq2 FROM p GROUP BY h", "mates")(
    lambda s, d: samtools.mates(derive.paired(s, d)).select("header", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2")))
query(f"""{_PAIRS} SELECT a.read_id, CASE WHEN b.h IS NULL THEN '*' WHEN b.rname = a.rname THEN '=' ELSE b.rname END AS rnext, coalesce(b.pos, 0) AS pnext,
CASE WHEN b.h IS NULL OR b.rname <> a.rname THEN 0 WHEN a.pos < b.pos OR (a.pos = b.pos AND a.r = 0) THEN greatest(a.e, b.e) - least(a.pos, b.pos) + 1 ELSE least(a.pos, b.pos) - greatest(a.e, b.e) - 1 END::INT AS tlen
FROM p a LEFT JOIN p b ON a.h = b.h AND a.r <> b.r""", "fill_mates")(lambda s, d: samtools.fill_mates(derive.paired(s, d)).select("read_id", "rnext", "pnext", "tlen"))


# Selections and views.

query(f"WITH {READS} SELECT read_id, seq FROM reads WHERE read_id IN (SELECT c_custkey FROM customer)", "reads_by_id")(
    lambda s, d: derive.reads(s, d).reads(derive.table(s, d, "customer").select(F.col("c_custkey").alias("read_id"))).sequences())
query(f"WITH {READS} SELECT read_id, seq FROM reads WHERE k BETWEEN 10 AND 499", "reads_by_place")(lambda s, d: derive.reads(s, d).ordinal(10, 500).sequences())
query(f"{BASE} SELECT position, sum(q)::BIGINT AS q FROM cells GROUP BY position", "quality_view")(
    lambda s, d: derive.reads(s, d).qualities().select(F.posexplode("q").alias("i", "v")).groupBy((F.col("i") + 1).alias("position")).agg(F.sum("v").alias("q")))
query(f"{WALK} SELECT position, loc, count(*) AS n, sum(q)::BIGINT AS q FROM ins WHERE q >= 20 OR q <= 0 GROUP BY ALL", "mask_insertions")(
    lambda s, d: derive.projected(s, d).low_bases_to_null(20).df.select(F.inline("insertions")).groupBy("position", "loc").agg(F.count("*").alias("n"), F.sum("q").alias("q")))
query(f"{WALK} SELECT count(*) AS n, (SELECT count(*) FROM ins) AS inserted FROM (SELECT read_id FROM used UNION ALL SELECT read_id FROM used WHERE read_id % 2 = 0)", "merge_drop_duplicates")(
    lambda s, d: merge_tables([(t := derive.projected(s, d)), t.where(F.col("read_id") % 2 == 0)], renumber=False, duplicates="drop").df.agg(F.count("*").alias("n"), F.sum(F.size("insertions")).alias("inserted")))
query(f"""WITH {READS} SELECT read_id, CASE WHEN regexp_matches(seq, '[AG][CT][ACGT]ACG') THEN 1 ELSE 0 END AS has FROM reads""", "degenerate_regex")(
    lambda s, d: derive.reads(s, d).df.select("read_id", F.col("seq").rlike(codon.degenerate_regex("RYNACG")).cast("int").alias("has")))
query("SELECT 3 AS start, 'TTGCAA' AS sequence, '000001001000' AS nt, '0110' AS residues", "library_alignment")(lambda s, d: _library(s))
query("SELECT o_orderkey AS k, o_orderkey + 7 AS p FROM orders", "codon_shift")(lambda s, d: derive.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), codon.shift(F.col("o_orderkey") + 1, 3).alias("p")))


def _library(s):
    a = codon.library_alignment("ACGTTGCAAGCT", "TTNCAR")
    return s.createDataFrame([(a["start"], a["sequence"], "".join(map(str, a["nt"])), "".join(map(str, a["residues"])))], "start int, sequence string, nt string, residues string")


# More alignment statistics.

query(f"""WITH {SAM} SELECT header, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM sam WHERE flag & 2304 = 0""", "sam_to_fastq")(
    lambda s, d: samtools.to_fastq(derive.sam(s, d)))
query(f"""WITH {SAM}, f AS (SELECT *, flag & 4 = 0 AS up, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MI]', 1), lambda x: x::INT)) AS m, list_sum(list_transform(range(1, 33), lambda i: ascii(qual[i]) - 33)) AS q FROM sam WHERE flag & 2304 = 0)
SELECT unnest(['sequences', 'letters', 'mapped', 'letters_mapped', 'longest', 'mean_quality']) AS metric, round(unnest([count(*)::DOUBLE, sum(length(seq))::DOUBLE, (count(*) FILTER (up))::DOUBLE, (sum(m) FILTER (up))::DOUBLE, max(length(seq))::DOUBLE, sum(q) / sum(length(qual))]), 6) AS value FROM f""", "sam_stats")(
    lambda s, d: r6(samtools.stats(derive.sam(s, d)), "value"))
query(f"""{WALK}, n AS (SELECT position, base, count(*) AS n FROM full_ GROUP BY ALL) SELECT 'ref' AS rname, position, sum(n)::BIGINT AS depth, string_agg(base || n, ',' ORDER BY n DESC, base DESC) AS bases FROM n GROUP BY position""", "pileup")(
    lambda s, d: samtools.pileup(derive.projected(s, d).cells().withColumn("rname", F.lit("ref"))).withColumn("bases", F.array_join(F.transform("bases", lambda b: F.concat(b["base"], b["n"])), ",")))
query(f"WITH {READS} SELECT k AS id, 32 AS length, md5(seq) AS md5 FROM reads", "fasta_dictionary")(lambda s, d: samtools.dictionary(derive.reads(s, d).df.select(F.col("read_id").alias("id"), "seq")))
query(f"WITH {READS} SELECT k AS id, 5 AS start, 5 + k % 9 AS stop, substr(seq, 5, (1 + k % 9)::INT) AS seq FROM reads JOIN customer ON c_custkey = k", "fasta_fetch")(
    lambda s, d: samtools.fetch(derive.reads(s, d).df.select(F.col("read_id").alias("id"), "seq"), derive.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(5).alias("start"), (5 + F.col("c_custkey") % 9).alias("stop"))))


# The tail probabilities of a binomial fall below the least double at k letters of n: heights beyond are capped.
_LEAST = "ln(5e-324)"
query(f"""{COUNTS}, g AS (SELECT position, letter, value AS k, sum(value) OVER (PARTITION BY position)::BIGINT AS n FROM n),
x AS (SELECT position, letter, k, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75) AS l FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM g)),
t AS (SELECT position, letter, max(l) FILTER (i >= k) AS a, max(l) FILTER (i <= k) AS b FROM x GROUP BY ALL),
u AS (SELECT position, letter, a + ln(sum(exp(l - a)) FILTER (i >= k)) AS above, b + ln(sum(exp(l - b)) FILTER (i <= k)) AS below FROM x JOIN t USING (position, letter) GROUP BY position, letter, a, b),
m AS (SELECT max(n) AS n FROM g),
y AS (SELECT k, i, n, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(2.5e-6) + (n - i) * ln(1 - 2.5e-6) AS l FROM (SELECT n, k, unnest(range(k, least(n, k + 60) + 1)) AS i FROM (SELECT n, unnest(range(1, least(n, 2000) + 1)) AS k FROM m))),
z AS (SELECT k, max(l) + ln(sum(exp(l - top))) AS above FROM (SELECT *, max(l) OVER (PARTITION BY k) AS top FROM y) GROUP BY k),
c AS (SELECT max(-above / ln(10)) AS cap FROM z WHERE above >= {_LEAST}),
w AS (SELECT position, letter, CASE WHEN above < {_LEAST} THEN 'inf'::DOUBLE WHEN below < {_LEAST} THEN '-inf'::DOUBLE ELSE (below - above) / ln(10) END AS v FROM u),
e AS (SELECT greatest(cap, coalesce((SELECT max(abs(v)) FROM w WHERE isfinite(v)), 0)) AS cap FROM c)
SELECT position, letter, round(CASE WHEN isfinite(v) THEN v ELSE sign(v) * cap END, 3) AS log_odds FROM w, e""", "plogo_capped")(lambda s, d: derive.reads(s, d).plogo()[0].withColumn("log_odds", F.round("log_odds", 3)))


@query(f"{COUNTS} SELECT position, letter, value FROM n")
def streaming_dist(s, d):
    """Counts of a stream over the orders file, run until it is read."""
    from strandloom.streaming import running

    schema = derive.table(s, d, "orders").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    name = f"streaming_dist_{abs(hash(d)) % 10**8}"
    out = running.running_distribution(derive.keyed(stream, "o_orderkey"), TableInfo(first=1, last=32))
    return running.to_memory(out, name)


def flagship(spark, sf_dir):
    return QUERIES["seq_dist_counts"](spark, sf_dir)
