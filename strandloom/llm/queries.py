"""The registered queries of the text operators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import common, decontam, lm, mixing, neardup, quality, sharding, substring, token_shards, toxicity, warc


def op1_substring_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.digest(substring.deduplicate(docs, keep=["doc_id"]))


def op2_lm_score(spark, sf_dir):
    return lm.score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op3_mixing(spark, sf_dir):
    return mixing.digest(common.table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.digest(common.table(spark, sf_dir, "documents"))


def op5_minhash_neardup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, size=2, keep=["doc_id"])


def op6_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(docs, common.table(spark, sf_dir, "labels"))


def op7_token_shards(spark, sf_dir):
    return token_shards.shards_of(common.table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(found)


def op9_quality_rules(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, keep=["doc_id"]).drop("rejected_by")


def op10_warc(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_toxicity": op6_toxicity,
    "op7_token_shards": op7_token_shards,
    "op10_warc": op10_warc,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
}

#: Words of each text, from 1: the text with white space runs made one space.
_WORDS = r"""
words AS (
  SELECT d.rid, d.doc_id, string_split(trim(regexp_replace(coalesce(d.text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents) d
),
sized AS (SELECT rid, doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM words)
"""

_OP1 = f"""
WITH {_WORDS},
win AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM sized WHERE len(w) >= 35)
),
hit AS (SELECT rid, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM hit),
kept AS (
  SELECT e.rid, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM sized) e
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = e.rid AND g.p = e.p) GROUP BY e.rid
)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, (len(s.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM sized s LEFT JOIN kept k USING (rid)
"""

_ASCII_LOWER = "translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = f"""
WITH RECURSIVE {_WORDS.replace("coalesce(d.text, '')", _ASCII_LOWER)},
sh AS (
  SELECT DISTINCT rid, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w), 2))) AS i FROM sized WHERE len(w) > 0)
),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
),
link AS (
  SELECT x, y FROM shared JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT rid AS x, rid AS y FROM sized UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y
),
comp AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM reach r JOIN sized d ON d.rid = r.y GROUP BY r.x)
SELECT s.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sized s JOIN comp c USING (rid) LEFT JOIN n USING (rid)
"""

_OP9 = f"""
WITH {_WORDS},
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM sized WHERE len(w) >= 8)
),
twice AS (SELECT rid, i FROM win JOIN (SELECT rid, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (rid, s)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
raw AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
line AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM raw) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
top AS (
  SELECT rid, max(c) AS n FROM (SELECT rid, x, count(*) AS c FROM (SELECT rid, unnest(w) AS x FROM sized) GROUP BY ALL) GROUP BY rid
),
f AS (
  SELECT s.rid, s.doc_id, s.w, len(s.w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(line.dup, 0)::BIGINT AS n_dup_lines, coalesce(line.n, 0) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS bangs, coalesce(top.n, 0) AS top
  FROM sized s JOIN raw USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN line USING (rid) LEFT JOIN top USING (rid)
),
g AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters,
    len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS capitals,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_dup_lines > n_lines OR 4 * bangs > n_words OR 10 * letters < 7 * n_words OR 2 * capitals > n_words
    OR 10 * top > 3 * n_words OR 5 * stutter > n_words) AS kept
FROM g
"""

_OP10 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
  FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INTEGER) >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""

_FOLDED = "string_split(trim(regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"
_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter({_FOLDED.format(t=_ASCII_LOWER)}, lambda x: x <> '') AS w FROM documents d),
b AS (SELECT item_id, list_filter({_FOLDED.format(t=_ASCII_LOWER)}, lambda x: x <> '') AS w FROM benchmark d),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
win AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k)
),
hit AS (SELECT rid, i, k, item_id FROM win JOIN pat USING (k, s)),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c USING (rid) LEFT JOIN items i USING (rid)
"""

ORACLES: dict[str, str] = {
    "op8_decontamination": _OP8,
    "op10_warc": _OP10,
    "op5_minhash_neardup": _OP5,
    "op9_quality_rules": _OP9,
    "op1_substring_dedup": _OP1,
}
