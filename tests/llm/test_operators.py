"""Every operator against a brute-force version, on rows with nulls, empty, long and repeated texts."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, decontam, gru, lm, mixing, neardup, permute, quality, sharding, substring, token_shards, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


CLASHES = ("n_words", "n_removed", "a", "b", "t", "k", "s", "c", "n", "id", "class", "data", "word", "words", "size", "rows", "place", "shard", "slot", "score", "kept", "held_out", "component_id", "target", "taken", "root", "path", "text_", "label")


def words(text):
    return WORD.findall(text or "")


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


# op1


def removed(rows, window):
    docs = [words(r[1]) for r in rows]
    count = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for r, d in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(d) - window + 1):
            if count[tuple(d[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((r[0], len(d), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(d) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500, "crowded": 1}, {"window": 12, "seed": 3}])
def test_substring(docs, rows, options):
    same(substring.digest(substring.deduplicate(docs, **options)), removed(rows, options.get("window", 35)))


def test_substring_clash_and_empty(docs, none):
    out = substring.deduplicate(docs.withColumns({c: F.lit("x") for c in CLASHES}))
    assert out.schema["n_words"].dataType.simpleString() == "bigint" and {r.a for r in out.collect()} == {"x"}
    assert substring.deduplicate(none).count() == 0


def test_copies_of_one_row_cost_no_more_than_ids(spark):
    import time

    text = " ".join(f"w{i}" for i in range(300))
    took = []
    for rows in ([(i, text) for i in range(5000)], [(7, text)] * 5000):
        began = time.perf_counter()
        got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("n_words", "n_removed", "kept_text").count().collect()
        took.append(time.perf_counter() - began)
        assert [tuple(r) for r in got] == [(300, 300, "", 5000)]
    assert took[1] < 2 * took[0] + 2


@pytest.mark.parametrize("crowded", [1, 200_000])
def test_copied_rows_beside_others(spark, crowded):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1, " ".join(base))] * 3 + [(2, " ".join(["x"] + base[40:90] + ["y"] * 40)), (3, " ".join(base[100:] + base[:20])), (4, " ".join(base[:36] + ["z"])), (5, None), (5, None)]
    same(substring.digest(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowded=crowded)), removed(rows, 35))


# op2


def test_language_model(docs, rows, none):
    got = lm.score(docs)
    train = [r for r in rows if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 != 1]
    count = Counter(w for r in train for w in words((r[1] or "").translate(LOWER)))
    count["\n"] = len(train)
    n, v = sum(count.values()), len(count)
    expected = []
    for r in rows:
        t = [*words((r[1] or "").translate(LOWER)), "\n"]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        expected.append((r[0], zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 == 1, len(t), sum(count[w] > 0 for w in t), n, round(base, 6)))
    same(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)), expected)
    assert all(r.score < 0 for r in got.collect())
    assert lm.score(none).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    """Text with order in it: the model must gain over the counts on documents it hasn't seen."""
    rng = random.Random(11)
    nouns = [f"noun{i}" for i in range(40)]
    rows = []
    for i in range(600):
        t = []
        for _ in range(40):
            n = rng.randrange(40)
            t += ["the", nouns[n], f"verb{n}", "rare" + str(rng.randrange(10**6))]
        rows.append((i, " ".join(t)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.3  # log10 a token


def test_tokens_without_training_documents_and_few_words(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm.score(spark.createDataFrame([(i, "Ab ab c\x0b") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 0, 0)} and all(math.isfinite(r.score) and r.score < 0 and abs(r.base_score - 4 * math.log10(1)) < 1e-9 for r in got)
    few = lm.score(spark.createDataFrame([(i, "ab ab c") for i in range(50)], "doc_id long, text string")).collect()
    assert len({round(r.score, 9) for r in few}) == 1 and few[0].score > few[0].base_score  # three words: the model still runs


def test_tokenised_finds_the_words():
    rng = random.Random(3)
    alphabet = [chr(i) for i in range(160)] + ["é", "  ", "Ä", "\u2003"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None, "", " \x0b"]
    flat, sizes = lm.tokenised(pa.array(texts, pa.string()).slice(5))
    want = [lm.words(t) for t in texts[5:]]
    assert sizes.tolist() == [len(w) for w in want] and lm._pieces(flat) == [x for w in want for x in w]


def test_rare_words_meet_their_counts_in_a_join(docs, monkeypatch):
    full = {r.doc_id: round(r.base_score, 6) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 64)
    assert {r.doc_id: round(r.base_score, 6) for r in lm.score(docs).collect()} == full


def test_a_task_of_the_model_holds_little_beside_its_texts(monkeypatch):
    """Scoring needs a few bytes for each token of a chunk: words lie open in parts, tokens are short numbers."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=500)) for _ in range(3000)]
    counts = Counter(w.encode() for t in texts for w in t.split())
    counts[lm.END] = len(texts)
    head = sorted(counts.items(), key=lambda x: -x[1])
    v = lm.Vocabulary(head, 1024, sum(counts.values()), len(counts), (np.ones(32, np.int64), np.ones(32, np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "in_0"])
    tokens = sum(counts.values())
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(gru, "log_likelihood", lambda p, docs, end: (np.zeros(len(docs)), gru.Lanes(docs, end, 1024))[0])
    monkeypatch.setattr(lm, "_PART", 1 << 20, raising=False)
    score = lm._score(SimpleNamespace(value=v), SimpleNamespace(value=None))
    rows = [r for b in score([batch.slice(0, 10)]) for r in b.to_pylist()]  # opens the vocabulary
    tracemalloc.start()
    try:
        made = list(score([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = [r for b in made for r in b.to_pylist()]
    assert [r["in_0"] for r in got] == [r["__k"] for r in got] == list(range(3000)) and [r["__base"] for r in got[:10]] == [r["__base"] for r in rows]
    assert sum(r["n_tokens"] for r in got) == tokens == sum(r["__known"] for r in got)
    assert peak < 32 * tokens, peak / tokens


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    counts, tails = rng.integers(1, 50, 64).astype(float), rng.integers(1, 50, 4).astype(float)
    p = gru.initial(counts, tails)
    docs = [np.tile(rng.permutation(68)[:6], 30).astype(np.int32) for _ in range(40)]
    total = np.logaddexp.reduce([gru.log_likelihood(p, [np.array([3, 9, k], np.int32)], 0)[0] for k in range(68)])
    assert abs(total - gru.log_likelihood(p, [np.array([3, 9], np.int32)], 0)[0]) < 1e-4
    before = gru.log_likelihood(p, docs, 0)
    one = [gru.log_likelihood(p, [d], 0)[0] for d in docs]
    assert np.allclose(before, one, atol=1e-2)  # lanes don't mix documents
    t = gru.Trainer(p)
    for _ in range(6):
        t.learn(docs, 0)
    assert gru.log_likelihood(t.p, docs, 0).sum() > before.sum() + 100


def test_symbols_and_classes_grow_with_the_vocabulary(spark):
    def made(distinct):
        counts = spark.range(distinct).select(F.concat(F.lit("w"), F.col("id")).cast("binary").alias("word"), (F.lit(2_000_000) - F.col("id")).alias("c"))
        return lm.vocabulary(counts)

    small, large = made(3000), made(200_000)
    assert small.symbols == 1024 and len(small.tail_total) == 32
    assert large.symbols >= 1700 and len(large.tail_total) > 32
    assert lm.sizes(3_000_000, lm.HEAD)[0] > 4 * lm.sizes(100_000, lm.HEAD)[0]
    # Words beyond rank 512, and words of all tail classes, are told apart.
    ids = large.open().model_symbols(large.ids([b"w600", b"w1500", b"w199999", b"unknown"]))
    assert ids[0] != ids[1] and ids[:2].max() < large.symbols <= ids[2:].min() and ids.max() < large.symbols + len(large.tail_total)
    assert large.tail_kinds.sum() == 200_000 - large.symbols


def test_wide_classes_are_a_distribution():
    rng = np.random.default_rng(2)
    p = gru.initial(rng.integers(1, 50, 128).astype(float), np.ones(3), width=64)
    total = np.logaddexp.reduce([gru.log_likelihood(p, [np.array([3, 9, k], np.int32)], 0)[0] for k in range(131)])
    assert abs(total - gru.log_likelihood(p, [np.array([3, 9], np.int32)], 0)[0]) < 1e-4


def test_weights_are_averaged_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(lm, "_HELD", 1)
    like = {"a": np.zeros(3, np.float32)}
    rows = [(k, k + 1, (np.arange(3) + k).astype("<f4") * (k + 1)) for k in range(7)]
    parts = spark.createDataFrame([(k, n, bytearray(w.tobytes())) for k, n, w in rows], lm._SCHEMA)
    got = lm.averaged(common.written(parts, "w"), 7, like)["a"]
    assert np.allclose(got, sum(w for *_, w in rows) / sum(n for _, n, _ in rows))


def test_gradient():
    rng = np.random.default_rng(1)
    p = gru.initial(rng.integers(1, 9, 32).astype(float), np.ones(2))
    doc = [rng.integers(0, 34, 7).astype(np.int32)]
    moved = {k: v.copy() for k, v in p.items()}
    t = gru.Trainer(moved, rate=1e-4)
    t.seen = {k: np.full(v.shape, 1e12, np.float32) for k, v in p.items()}  # plain steps: rate * g / 1e6
    t.rate = 1e6 * 1e-3
    t.learn(doc, 0)
    for k in p:
        g = (p[k] - moved[k]).astype(float) / 1e-3
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for sign in (1, -1):
            q = {n: v.astype(np.float64).copy() for n, v in p.items()}
            q[k][i] += sign * 1e-3
            ends.append(-gru.log_likelihood(q, doc, 0)[0] / 7)
        assert math.isclose((ends[0] - ends[1]) / 2e-3, g[i], rel_tol=0.05, abs_tol=2e-3), k


def test_clashing_columns(spark, docs, rows):
    """Columns under the operators' own names, inner and outer, neither break nor leak."""
    d = docs.withColumns({c: F.lit("x") for c in CLASHES})
    bench, labels = spark.createDataFrame([(1, rows[20][1])], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    plain = {r.doc_id: r.base_score for r in lm.score(docs).collect()}
    assert {r.doc_id: r.base_score for r in lm.score(d).collect()} == plain
    for out in (neardup.near_duplicates(d, size=2), sharding.shard(d), quality.assess(d), decontam.contamination(d, bench), toxicity.score(d, toxicity.train(d, labels))):
        got = out.collect()
        assert len(got) == len(rows) and {r["path"] for r in got} == {"x"}
    for out in (neardup.one_of_each(d, size=2), decontam.decontaminate(d, bench), toxicity.without_toxic(d, labels), mixing.mix_documents(d)):
        assert out.columns == d.columns and {r["taken"] for r in out.collect()} == {"x"}
    assert mixing.digest(d).count() == len(rows)


# op3


def test_shares():
    assert mixing.shares([10, 10, 10]) == [5.0, 10.0, 15.0]
    got = mixing.shares([1000, 10, 10])
    assert got[1:] == [30.0, 30.0] and got[0] == 960.0 and sum(got) == 1020
    assert mixing.shares([]) == [] and mixing.shares([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("block", [4, 50, 1024])
def test_mixing(docs, rows, block):
    m = mixing.Mix(docs, block=block, shard_slots=16, bucket_rows=10)
    got = m.taken().collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.shares([size[s] for s in order]), strict=True))
    assert Counter((r["__id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert taken == {(size[s], round(target[s], 6)): int(target[s]) for s in order}
    assert Counter(map(tuple, m.taken().collect())) == Counter(map(tuple, got))  # reruns agree
    slots = m.slots().collect()
    for g in {s.shard for s in slots}:
        places = sorted(s.place for s in slots if s.shard == g)
        assert places == list(range(len(places)))


def test_mixed_documents(docs, rows, none):
    out = mixing.mix_documents(docs, block=50)
    assert out.columns == docs.columns
    full = {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r.n_chars == len(r.text) and (r.text == full[r.doc_id] or r.text in " ".join(words(full[r.doc_id])))
    assert mixing.mix_documents(none).count() == 0 and mixing.digest(none).count() == 0


# op4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, 7, "k")).collect()]
    assert sorted(got) == list(range(n)) and (n < 16 or got != sorted(got))


def test_matrix():
    m = sharding.matrix([5, 0, 17, 3], [7, 6, 6, 6], 1)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m, strict=True)] == [7, 6, 6, 6]
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 3e5) < 120 and 300 < np.std(big) < 700


def test_sharding(docs, rows, none):
    got = sharding.digest(docs).collect()
    expected = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(expected)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[j]) for j in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.digest(none).count() == 0
    kept = sharding.shard(docs.withColumn("shard", F.lit("x")), shards=3)
    assert kept.count() == len(rows) and "text" in kept.columns


def test_sharding_runs_no_python(docs):
    plan = sharding.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Window|Sort", plan) and plan.count("Exchange") <= 3


# op5


def components(rows, size, percent=80):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if c and 100 * c >= percent * (len(a) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, none, size):
    same(neardup.near_duplicates(docs, size=size, keep=["doc_id"]), components(rows, size))
    assert neardup.near_duplicates(none, size=size).count() == 0


def test_hot_regions_and_blocks(docs, rows, monkeypatch):
    for name, value in (("PAIRS", 3), ("NEAR", 2), ("BLOCK", 4), ("REGION", 5)):
        monkeypatch.setattr(neardup, name, value)
    same(neardup.near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept"), components(rows, 2))


def test_one_of_each(docs, rows):
    out = neardup.one_of_each(docs, size=2)
    assert out.columns == docs.columns
    full = [r for r in rows if words(r[1])]
    want = {c[2] if c[2] is not None else ("x", r[1]) for r, c in zip(rows, components(rows, 2), strict=True) if words(r[1])}
    got = out.collect()
    assert sum(1 for r in got if words(r.text)) == len(want) and len(got) == len(want) + len(rows) - len(full)


def test_links_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(60)]
    forest = neardup.Forest(60)
    for a, b in neardup.links(sets, 50):
        forest.join(a, b)
    brute = neardup.Forest(60)
    for i in range(60):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 50 * (len(sets[i]) + len(sets[j]) - c):
                brute.join(i, j)
    assert [forest.root(i) for i in range(60)] == [brute.root(i) for i in range(60)]


# op6


def toxic_sample(seed, n=240):
    from tests.llm.conftest import prose

    rng, texts, labels = random.Random(seed), [], []
    for i in range(n):
        t, y = prose(rng, rng.choice(["en", "de"]), 40).split(), int(i % 4 == 0)
        for _ in range(2 * y):
            t.insert(rng.randrange(len(t)), rng.choice(["grompf", "blurdak", "zwexxi" + rng.choice(["ung", "en"])]))
        texts.append(" ".join(t))
        labels.append(y)
    return texts, labels


def test_toxicity_held_out():
    m = toxicity.fit(*toxic_sample(1))
    texts, labels = toxic_sample(2)
    s = [m.score(m.evidence(t)) for t in texts]
    hit = [x >= 0.7 for x in s]
    assert sum(h for h, y in zip(hit, labels, strict=True) if y) >= 0.9 * sum(labels)
    assert sum(h for h, y in zip(hit, labels, strict=True) if not y) <= 0.05 * (len(labels) - sum(labels))
    assert 0 <= m.score(m.evidence(None)) < 0.5 and m.score(m.evidence("")) == m.score(m.evidence(None))
    assert len(m.evidence("x" * 500_000)) == 3


def test_toxicity_frames(spark, docs, none):
    texts, labels = toxic_sample(3)
    d = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)] + [(1, None), (2, "")], "doc_id long, text string")
    y = spark.createDataFrame([(1000 + i, int(v)) for i, v in enumerate(labels)] + [(5, None)], "doc_id long, toxic int")
    out = toxicity.digest(d, y).collect()
    assert len(out) == len(texts) + 2 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    kept = toxicity.without_toxic(d.withColumn("score", F.lit(9)), y)
    assert kept.columns == ["doc_id", "text", "score"] and 150 < kept.count() < len(texts)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.digest(docs, empty).collect()} == {0.5}
    assert toxicity.digest(none, y).count() == 0


# op7


def test_tokens(spark, docs, rows, none, tmp_path):
    out = str(tmp_path / "t")
    made = token_shards.materialise(docs.drop("n_chars"), out, length=64, shard_bytes=64 * 2 * 5).collect()
    enc = token_shards.encoder(token_shards.vocabulary(token_shards.TOKENIZER))
    end = 50256
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1]))) for r in rows if r[1])
    slots = list(token_shards.read_slots(out, 0))
    assert sorted(r.slot for r in made) == list(range(len(slots)))
    pieces = sum(r.n_tokens for r in made)
    assert pieces == sum(len(t) + 1 for (_, t), n in want.items() for _ in range(n))
    starts = Counter()
    for r in made:
        data = slots[r.slot]
        assert hashlib.sha256(data.tobytes()).hexdigest() == r.sha256 and (data[r.n_tokens :] == end).all()
        for d, s in zip(r.doc_ids, r.starts, strict=True):
            if s == 0 or data[s - 1] == end:
                starts[d] += 1
    short = [(d, t) for (d, t) in want if len(t) < 20]
    flat = {r.slot: slots[r.slot][: r.n_tokens].tolist() for r in made}
    for d, t in short:
        need = [*t, end]
        assert any(d in r.doc_ids and any(flat[r.slot][s : s + len(need)] == need for s in r.starts) for r in made) or any(d in r.doc_ids and max(r.starts) + len(need) > 64 for r in made)
    assert [a.tolist() for a in token_shards.read_slots(out, 7, 6)] == [a.tolist() for a in slots[7:13]]
    assert token_shards.materialise(none, str(tmp_path / "e")).count() == 0 and list(token_shards.read_slots(str(tmp_path / "e"), 0)) == []


def test_every_document_comes_back_from_its_tokens(spark, docs, rows, tmp_path):
    """One input part keeps documents in order; sequences put back in the order of their numbers give every text."""
    out = str(tmp_path / "t")
    made = {r.slot: r for r in token_shards.materialise(docs.coalesce(1), out, length=64, shard_bytes=64 * 2 * 5).collect()}
    enc = token_shards.encoder(token_shards.vocabulary(token_shards.TOKENIZER))
    slots = [a.tolist() for a in token_shards.read_slots(out, 0)]
    place = [r[0] for r in spark.range(len(slots)).select(permute.permuted(F.col("id"), len(slots), 20240507)).collect()]
    tokens = [t for s in place for t in slots[s][: made[s].n_tokens]]
    texts, now = [], []
    for t in tokens:
        if t == 50256:
            texts.append(enc.decode(now))
            now = []
        else:
            now.append(t)
    assert not now and Counter(texts) == Counter(r[1] for r in rows if r[1])
    firsts = [d for s in place for d, b in zip(made[s].doc_ids, made[s].starts) if b or s == place[0]]
    assert set(firsts) <= {r[0] for r in rows}


def test_pack_is_lossless():
    docs = [(1, list(range(10))), (2, [7]), (3, list(range(100, 131)))]
    got = list(token_shards.pack(iter(docs), 8, 999, "H"))
    assert [x for n, s, _ in got for x in s[:n]] == [*range(10), 999, 7, 999, *range(100, 131), 999]
    assert got[0][2] == [(1, 0)] and got[1][2] == [(1, 0), (2, 3), (3, 5)] and got[2][2] == [(3, 0)]


# op8


def contaminated(rows, items, window=10):
    def fold(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    found = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add(i)
    out = []
    for r in rows:
        w, hit, ids = fold(r[1]), set(), set()
        for p, of in found.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    ids |= of
        names = sorted(str(i) for i in ids if i is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, rows, none):
    long = " ".join(words(rows[85 if rows[85][1] else 0][1] or rows[20][1])[5:40])
    items = [(1, rows[20][1]), (2, rows[62][1].upper()), (3, "one"), (4, None), (5, "!!"), (10, " ".join(words(rows[77][1])[30:60])), (11, "same same same"), (12, long), (12, "nbsp ÉCLAIR"), (None, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = contaminated(rows, items)
    assert sum(r[5] for r in expected) > 10
    same(decontam.digest(decontam.contamination(docs, bench)), expected)
    same(decontam.digest(decontam.contamination(docs, bench, block_bytes=200, keep=["doc_id"])), expected)
    kept = decontam.decontaminate(docs.withColumn("n_hit", F.lit(5)), bench)
    assert kept.columns == [*docs.columns, "n_hit"] and kept.count() == sum(not r[5] for r in expected)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# op9


def counts(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, rows, none):
    extra = [(200, "a b\na b\n\na b\nc", "en", "a", 0), (201, "#x $y " * 30, "en", "a", 0), (202, "LOUD WORDS!! " * 3 + "ANOTHER THING THAT SHOUTS ALL THE TIME WITHOUT ANY REASON AT ALL OR EVER SO", "en", "a", 0)]
    d = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = quality.assess(d)
    expected = []
    for r in [*rows, *extra]:
        n, *rest = counts(r[1])
        expected.append((r[0], n, *rest, n < 20 or 100 * rest[3] > 30 * n))
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), expected)
    verdict = {r.doc_id: (r.kept, r.base_failed) for r in out.collect()}
    assert verdict[0][0] or verdict[0][1]
    assert not verdict[201][0] and not verdict[202][0] and not verdict[84][0]
    orders = [[r.name for r in quality.RULES], [r.name for r in quality.RULES][::-1]]
    a, b = (quality.assess(d, order=o).select("doc_id", "kept").collect() for o in orders)
    assert Counter(a) == Counter(b)
    assert quality.assess(none).count() == 0 and set(quality.plan([])) == {r.name for r in quality.RULES}


NAMES = ("__a", "__b", "__n", "__p", "__text", "__k", "__part", "__place", "__class", "a.b", "in_0", "in_1", "t", "T.t", "copies", "hit_Spans", "N_words", "od`d")


def test_inner_and_odd_names_and_text_ids(spark, docs, rows):
    """Columns under inner names, with dots or backticks, stay; ids may be strings."""
    d = docs.withColumns({c: F.lit("x") for c in NAMES}).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    bench, labels = spark.createDataFrame([("q", rows[20][1])], "item_id string, text string"), spark.createDataFrame([("id3", 1)], "doc_id string, toxic int")
    for out in (lm.score(d), neardup.near_duplicates(d, size=2), sharding.shard(d), quality.assess(d), decontam.contamination(d, bench), decontam.contamination(d, bench, block_bytes=100), substring.deduplicate(d),
                toxicity.score(d, toxicity.train(d, labels))):
        got = out.collect()
        assert len(got) == len(rows) and {(r["__a"], r["__text"], r["a.b"], r["in_0"], r["od`d"]) for r in got} == {("x",) * 5}, out.columns
    for out in (neardup.one_of_each(d, size=2), decontam.decontaminate(d, bench), toxicity.without_toxic(d, labels), mixing.mix_documents(d)):
        assert out.columns == d.columns and {(r["__a"], r["a.b"], r["in_0"]) for r in out.collect()} == {("x",) * 3}
    made = token_shards.shards_of(d).collect()
    assert {i for r in made for i in r.doc_ids if i} == {f"id{r[0]}" for r in rows if r[1] and r[0] is not None}


def test_draws_meet_the_slots(spark):
    slots = [5000, 0, 70_000, 1, 333]
    one, other = ([tuple(r) for r in mixing.draws(spark, slots, 16, 3, most).collect()] for most in (1, 1 << 18))
    assert sorted(one) == sorted(other)  # wherever the tree is cut
    assert [sum(r[3] for r in one if r[1] == k) for k in range(5)] == slots
    full = Counter()
    for r in one:
        full[r[0]] += r[3]
    assert set(full.values()) <= {16, sum(slots) % 16} and len(full) == -(-sum(slots) // 16)
    for k in range(5):
        at = 0
        for r in sorted(x for x in one if x[1] == k):
            assert r[2] == at
            at += r[3]
    a, b = np.array([sum(r[3] for r in one if r[1] == 2 and r[0] % 2 == p) for p in (0, 1)])
    assert abs(a - b) < 500


def test_thresholds_follow_the_compressed_lengths():
    """Every ratio that a text's evidence holds is the stored threshold of a rescored window."""
    texts, labels = toxic_sample(5)
    m = toxicity.fit(texts, labels)
    for t in texts[:60]:
        want = toxicity.top(m.ratio.get(m.cell(w), -1.0) for w in toxicity.windows(t))
        assert m.evidence(t) == want and abs(m.score(want) - 1 / (1 + math.exp(-(m.weights[0] + sum(w * x for w, x in zip(m.weights[1:], want)))))) < 1e-9


def test_training_text_is_bounded(spark):
    texts, labels = toxic_sample(3)
    d = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)] + [(1000, "a second text of an id")], "doc_id long, text string")
    y = spark.createDataFrame([(1000 + i, int(v)) for i, v in enumerate(labels)], "doc_id long, toxic int")
    assert toxicity.train(d, y, sample_bytes=100).ratio == {} and toxicity.train(d, y).ratio
