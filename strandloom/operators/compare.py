"""Reads against references: matches, Hamming distances, mutation profiles, weight matrices.

References, weight matrices and position lists come from the driver as literals or small
broadcast tables (their rows are counted there).  Distances are folded inside the row;
the reads x positions x references cube exists only when it is asked for.
"""

from __future__ import annotations

import warnings
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.dist import cells, checked, counts, dense, runs
from strandloom.schema import TRANSITIONS, TableInfo

MOST_REFERENCES = 100_000
_PAIRS = 20_000_000  # of a task


def reference_table(spark, seqs, info: TableInfo, positions=None, ids=None) -> tuple[DataFrame, list[int]]:
    """(ref_id, ref) of equal length, and the positions they cover: the first of the table unless given."""
    seqs = [seqs] if isinstance(seqs, str) else list(seqs)
    if len(seqs) > MOST_REFERENCES:
        raise ValueError(f"over {MOST_REFERENCES} references: compare in blocks")
    width = max(map(len, seqs))
    ids = list(ids) if ids is not None else list(range(1, len(seqs) + 1))
    where = list(positions) if positions is not None else info.positions[:width]
    rows = [(i, s.upper().ljust(width, info.fill)[: len(where)]) for i, s in zip(ids, seqs, strict=True)]
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"ref_id {kind}, ref string"), where


def shared(info: TableInfo, reference: list[int], wanted=None, set_diff=False) -> list[int]:
    """Positions to compare: of the table and the reference (and the wanted ones), or with ``set_diff`` all but the wanted."""
    have = set(reference)
    both = [p for p in info.positions if p in have]
    if set_diff:
        if wanted is None:
            raise ValueError("set_diff needs positions")
        return sorted(set(both) - set(wanted))
    return both if wanted is None else [p for p in both if p in set(wanted)]


def pick(seq: Column, first: int, positions: list[int]) -> Column:
    """The letters at ``positions`` as an array."""
    parts = [F.split(F.substring(seq, a - first + 1, b - a + 1), "") for a, b in runs(positions)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def is_match(a: Column, b: Column, flip=False, treat=(), ignore=()) -> Column:
    """a equals b, or either is in ``treat``; negated by ``flip``; null where either is in ``ignore``."""
    same = a == b
    if treat:
        same = same | a.isin(*treat) | b.isin(*treat)
    same = ~same if flip else same
    return F.when(~(a.isin(*ignore) | b.isin(*ignore)), same) if ignore else same


def _pairs(df, info, seqs, wanted=None, ref_positions=None, set_diff=False, ids=None, keep=("read_id",), tasks=None):
    refs, where = reference_table(df.sparkSession, seqs, info, ref_positions, ids)
    positions = shared(info, where, wanted, set_diff)
    at = {p: i for i, p in enumerate(where)}
    first = where[0] if where == list(range(where[0], where[0] + len(where))) else None
    if first is not None:
        letters = pick(F.col("ref"), first, positions)
    else:
        letters = F.array(*(F.substring("ref", at[p] + 1, 1) for p in positions))
    refs = refs.select("ref_id", letters.alias("__r"))
    reads = df.select(*keep, pick(F.col("seq"), info.first, positions).alias("__s"))
    return _dealt(reads, tasks).crossJoin(F.broadcast(refs)), positions


def _dealt(reads: DataFrame, tasks: int | None) -> DataFrame:
    """For many references: a small file would be one task, and generated code would build a read's letters anew for each pair."""
    return reads if tasks is None else reads.repartition(tasks)


def compare(df, info, seqs, positions=None, *, ref_positions=None, set_diff=False, flip=False, ignore=(), treat=(), ids=None) -> DataFrame:
    """(read_id, ref_id, position, is_match); null where a letter is ignored."""
    both, where = _pairs(df, info, seqs, positions, ref_positions, set_diff, ids)
    numbers = F.array(*(F.lit(p) for p in where))
    zipped = F.arrays_zip(numbers.alias("position"), F.col("__s").alias("a"), F.col("__r").alias("b"))
    out = both.select("read_id", "ref_id", F.inline(zipped))
    return out.select("read_id", "ref_id", "position", is_match(F.col("a"), F.col("b"), flip, treat, ignore).alias("is_match"))


_LETTERS = 7  # in a block: no sum below leaves 63 bits
_SEVENS, _EIGHTS = int("7f" * _LETTERS, 16), int("80" * _LETTERS, 16)
_INLINE = 64  # blocks compared in generated code; longer reads fold over arrays


def _blocks(seq: Column, n: int) -> list[Column]:
    """Seven ASCII letters to a number."""
    return [F.conv(F.hex(F.substring(seq, i + 1, _LETTERS)), 16, 10).cast("long") for i in range(0, n, _LETTERS)]


def _unequal_bytes(a: Column, b: Column) -> Column:
    return F.bit_count((a.bitwiseXOR(b) + F.lit(_SEVENS)).bitwiseAND(F.lit(_EIGHTS)))


def _packed_hamming(df, info, seqs, wanted, ref_positions, set_diff, ids, tasks=None) -> DataFrame:
    """Plain mismatches, seven letters at a time."""
    refs, where = reference_table(df.sparkSession, seqs, info, ref_positions, ids)
    positions = shared(info, where, wanted, set_diff)
    at = {p: i for i, p in enumerate(where)}
    mine = F.concat(*(F.substring("seq", a - info.first + 1, b - a + 1) for a, b in runs(positions))) if positions else F.lit("")
    theirs = F.concat(*(F.substring("ref", at[a] + 1, b - a + 1) for a, b in _joint_runs(positions, at))) if positions else F.lit("")
    n = len(positions)
    inline = n <= _LETTERS * _INLINE

    def packed(text, name):
        if inline:
            return [c.alias(f"{name}{i}") for i, c in enumerate(_blocks(text, n))]
        return [F.array(*_blocks(text, n)).alias(name)]

    reads = _dealt(df.select("read_id", *packed(mine, "__s")), tasks)
    both = reads.crossJoin(F.broadcast(refs.select("ref_id", *packed(theirs, "__r"))))
    if inline:
        distance = sum((_unequal_bytes(F.col(f"__s{i}"), F.col(f"__r{i}")) for i in range(-(-n // _LETTERS))), F.lit(0)).cast("long")
    else:
        distance = F.aggregate(F.zip_with("__s", "__r", _unequal_bytes), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select("read_id", "ref_id", distance.alias("distance"))


def _joint_runs(positions: list[int], at: dict[int, int]) -> list[tuple[int, int]]:
    """Runs of positions that are consecutive in the table and in the reference."""
    out: list[list[int]] = []
    for p in positions:
        if out and p == out[-1][1] + 1 and at[p] == at[out[-1][1]] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def hamming(df, info, seqs, positions=None, *, ref_positions=None, set_diff=False, ignore=(), treat=(), normalized=False, ids=None, tasks=None) -> DataFrame:
    """(read_id, ref_id, distance): mismatches, or their share of the comparable bases."""
    if not (ignore or treat or normalized):
        return _packed_hamming(df, info, seqs, positions, ref_positions, set_diff, ids, tasks)
    both, _ = _pairs(df, info, seqs, positions, ref_positions, set_diff, ids, tasks=tasks)
    miss = F.zip_with("__s", "__r", lambda a, b: is_match(a, b, True, treat, ignore))
    n = F.size(F.filter(miss, lambda x: x)).cast("long")
    if normalized:
        n = F.try_divide(n.cast("double"), F.size(F.filter(miss, lambda x: x.isNotNull())).cast("double"))
    return both.select("read_id", "ref_id", n.alias("distance"))


def pairwise(df, info, other: DataFrame, positions=None, *, one_hot=False) -> DataFrame:
    """(read_id, other_id, distance) of all reads against a block of reads, which is collected: at most MOST_REFERENCES.

    ``one_hot`` counts letters other than A, C, G, T as mismatches, even with themselves."""
    rows = other.select("read_id", "seq").limit(MOST_REFERENCES + 1).collect()
    if not rows:
        return df.select("read_id", F.col("read_id").alias("other_id"), F.lit(0).cast("long").alias("distance")).limit(0)
    seqs, ids = [r.seq for r in rows], [r.read_id for r in rows]
    tasks = max(1, -(-df.count() * len(rows) // _PAIRS))
    if one_hot:
        both, _ = _pairs(df, info, seqs, positions, ids=ids, tasks=tasks)
        miss = F.filter(F.zip_with("__s", "__r", lambda a, b: (a != b) | ~a.isin(*"ACGT")), lambda x: x)
        return both.select("read_id", F.col("ref_id").alias("other_id"), F.size(miss).cast("long").alias("distance"))
    return hamming(df, info, seqs, positions, ids=ids, tasks=tasks).withColumnRenamed("ref_id", "other_id")


def error_rate(df, info, seqs, positions=None, **options) -> DataFrame:
    """(ref_id, position, match_rate, error_rate)."""
    c = compare(df, info, seqs, positions, **options)
    m = F.avg(F.col("is_match").cast("int"))
    return c.groupBy("ref_id", "position").agg(m.alias("match_rate"), (1 - m).alias("error_rate"))


def mutations(df, info, seqs, positions=None, *, ref_positions=None, set_diff=False, ignore=(), treat=(), normalized=False, by_position=False, ids=None) -> DataFrame:
    """(ref_id[, position], ref_base, read_base, value): how often reads have ``read_base`` for ``ref_base``.  All letters
    of the table appear at all positions, with 0 if need be; ``normalized`` divides by everything compared, matches too."""
    refs, where = reference_table(df.sparkSession, seqs, info, ref_positions, ids)
    used = shared(info, where, positions, set_diff)
    grid = dense(counts(df, info, used, ignore))
    at = refs.select("ref_id", F.posexplode(F.split("ref", "")).alias("i", "ref_base"))
    at = at.select("ref_id", F.get(F.array(*(F.lit(p) for p in where)), F.col("i")).alias("position"), "ref_base").where(F.col("position").isin(used))
    if ignore:
        at = at.where(~F.col("ref_base").isin(*ignore))
    both = grid.join(F.broadcast(at), "position").withColumnRenamed("letter", "read_base")
    if normalized:
        both = both.withColumn("__all", F.sum("value").over(Window.partitionBy("ref_id")))
    both = both.where(F.col("ref_base") != F.col("read_base"))
    if treat:
        both = both.where(~(F.col("ref_base").isin(*treat) | F.col("read_base").isin(*treat)))
    keys = ["ref_id", *(["position"] if by_position else []), "ref_base", "read_base"]
    value = F.sum("value")
    if normalized:
        value = F.try_divide(value.cast("double"), F.max("__all").cast("double"))
    return both.groupBy(*keys).agg(value.alias("value"))


def ts_tv(df, info, seqs, positions=None, *, by_position=False, **options) -> DataFrame:
    """(ref_id[, position], ratio, ts, tv): shares of transitions and transversions among all mutations."""
    if info.seq_type != "NT":
        raise ValueError("transitions need nucleotides")
    m = mutations(df, info, seqs, positions, by_position=by_position, **options)
    pair = F.concat("ref_base", "read_base")
    dna = F.col("ref_base").isin(*"ACGT") & F.col("read_base").isin(*"ACGT")
    ts = F.sum(F.when(pair.isin(*("".join(t) for t in sorted(TRANSITIONS))), F.col("value")).otherwise(0)).cast("double")
    tv = F.sum(F.when(dna & ~pair.isin(*("".join(t) for t in sorted(TRANSITIONS))), F.col("value")).otherwise(0)).cast("double")
    every = F.sum("value").cast("double")
    zero = F.lit(0.0)
    return m.groupBy("ref_id", *(["position"] if by_position else [])).agg(
        F.try_divide(ts, tv).alias("ratio"), F.coalesce(F.try_divide(ts, every), zero).alias("ts"), F.coalesce(F.try_divide(tv, every), zero).alias("tv"))


def pwm(df, info, matrix: list[list[float]], letters="ACGT", positions=None, *, product=True, null_score=1.0) -> DataFrame:
    """(read_id, score): product or sum of the weights of a read's letters; letters without a column score ``null_score``."""
    where = checked(info, positions)
    if len(matrix) != len(where):
        raise ValueError(f"{len(matrix)} rows of weights for {len(where)} positions")
    table = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in matrix))
    weights = F.zip_with(pick(F.col("seq"), info.first, where), table, lambda c, row: F.coalesce(F.get(row, F.instr(F.lit(letters), c) - 1), F.lit(float(null_score))))
    start = F.lit(1.0 if product else 0.0)
    return df.select("read_id", F.aggregate(weights, start, (lambda a, x: a * x) if product else (lambda a, x: a + x)).alias("score"))


def words(df, info, k: int, positions=None, *, weight=None) -> DataFrame:
    """(positions, word, value): for every k of the positions, in order, how often each word stands there."""
    where = checked(info, positions)
    letters = F.transform("positions", lambda p: F.substring(F.col("seq"), p - info.first + 1, F.lit(1)))
    return _words(df, "seq", k, [F.lit(p) for p in where], "array<array<int>>", letters, weight)


def words_with_insertions(df, info, k: int, positions=None, *, weight=None, least=0, lower=True, gap="-") -> DataFrame:
    """The same over base and insertion columns: positions are structs of position and loc."""
    from strandloom.operators.insertions import exploded, strings

    # Columns are few: positions of a read and what is inserted before them.
    count = exploded(df, info, positions, keep=()).groupBy("position", "loc").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    where = sorted([(p, 0) for p in checked(info, positions)] + [(r.position, r.loc) for r in count])
    text = strings(df, info, positions=positions, least=least, lower=lower, gap=gap, keep=[weight] if weight else [])
    number = F.create_map(*(x for i, (p, loc) in enumerate(where) for x in (F.struct(F.lit(p).alias("position"), F.lit(loc).alias("loc")), F.lit(i + 1))))
    letters = F.transform("positions", lambda c: F.substring(F.col("seqs"), F.try_element_at(number, c), F.lit(1)))
    columns = [F.struct(F.lit(p).alias("position"), F.lit(loc).alias("loc")) for p, loc in where]
    return _words(text, "seqs", k, columns, "array<array<struct<position:int,loc:int>>>", letters, weight)


def _words(df, seq, k, columns, kind, letters, weight):
    if k > len(columns):
        warnings.warn("word longer than the positions", stacklevel=3)
    combos = [F.array(*c) for c in combinations(columns, k)]
    lists = F.array(*combos) if combos else F.array().cast(kind)
    long = df.select(*([weight] if weight else []), seq, F.explode(lists).alias("positions"))
    value = F.sum(F.col(weight).cast("double")) if weight else F.count("*")
    return long.groupBy("positions", F.array_join(letters, "").alias("word")).agg(value.alias("value"))
