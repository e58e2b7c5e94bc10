"""Merging read tables: stacked reads, or overlapping tables of the same reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.schema import DELETION, INSERTIONS, NULL_QUALITY, TableInfo


def _window(infos: list[TableInfo]) -> tuple[int, int]:
    kinds = {i.seq_type for i in infos}
    if len(kinds) > 1:
        raise ValueError("tables of different sequence types")
    return min(i.first for i in infos), max(i.last for i in infos)


def _widened(df, info: TableInfo, first, last, n):
    def fit(c, pad):
        return F.concat(F.repeat(F.lit(pad), F.lit(info.first - first)), c, F.repeat(F.lit(pad), F.lit(last - info.last)))

    qual = fit(F.coalesce("qual", F.repeat(F.lit(NULL_QUALITY), F.lit(info.last - info.first + 1))), NULL_QUALITY) if info.has_quality else F.repeat(F.lit(NULL_QUALITY), F.lit(last - first + 1))
    ins = F.col("insertions") if info.has_insertions else F.array().cast(INSERTIONS)
    return df.select(F.lit(n).alias("table_ord"), "read_id", "read_ord", fit(F.col("seq"), DELETION).alias("seq"), qual.alias("qual"), ins.alias("insertions"))


def _info(infos, first, last):
    refs = tuple(r for i in infos for r in i.references)
    user = reduce(lambda a, b: {**a, **b.user}, infos, {})
    return infos[0].having(first=first, last=last, has_quality=True, has_insertions=any(i.has_insertions for i in infos), references=refs, user=user)


def stack(tables: list[tuple[DataFrame, TableInfo]], *, renumber=True, duplicates="assert") -> tuple[DataFrame, TableInfo]:
    """All reads over the union of positions; missing cells are gaps of null quality.  ``renumber`` gives new ids 1, 2 …
    in table and read order; otherwise ids stay and equal (read, position, loc) insertions follow ``duplicates``."""
    infos = [i for _, i in tables]
    first, last = _window(infos)
    out = reduce(DataFrame.unionByName, (_widened(df, i, first, last, n) for n, (df, i) in enumerate(tables)))
    if renumber:
        out = _numbered(out)
    elif any(i.has_insertions for i in infos):
        out = resolve(out, duplicates)
    return out.drop("table_ord"), _info(infos, first, last)


_DRAWN = 8  # keys drawn for each slice


def _numbered(df: DataFrame, slices: int = 1024) -> DataFrame:
    """Ids 1.. in (table_ord, read_ord) order by slices: a prefix sum over their counts, no single sorted partition.
    Keys alone decide their slice, so counts and rows agree, whatever partitions either is planned with."""
    key = F.struct("table_ord", "read_ord")
    share = F.lit(float(_DRAWN * slices)) / F.greatest(df.agg(F.count("*")).scalar(), F.lit(1))
    drawn = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 53)) < share * F.lit(float(1 << 53))).distinct()
    bounds = drawn.agg(F.filter(F.array_sort(F.collect_list("k")), lambda k, i: i % _DRAWN == 0)).scalar()
    cut = df.withColumn("__slice", F.lit(0))
    for bit in reversed(range((2 * slices - 1).bit_length())):  # how many bounds are at most the key, by halves
        end = F.col("__slice") + (1 << bit)
        cut = cut.withColumn("__slice", F.when(F.get(bounds, end - 1) <= key, end).otherwise(F.col("__slice")))
    local = cut.withColumn("__i", F.row_number().over(Window.partitionBy("__slice").orderBy("table_ord", "read_ord")))
    sizes = cut.groupBy("__slice").agg(F.count("*").alias("__n"))
    base = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).drop("__n")  # one row per slice
    out = local.join(F.broadcast(base), "__slice")
    number = (F.col("__base") + F.col("__i")).cast("long")
    return out.withColumns({"read_id": number, "read_ord": number}).drop("__slice", "__i", "__base")


def resolve(df: DataFrame, duplicates: str) -> DataFrame:
    """Equal (read, position, loc) insertions across rows: 'assert' fails, 'ignore' keeps all, 'drop' keeps the first table's."""
    if duplicates == "ignore":
        return df
    if duplicates not in ("assert", "drop"):
        raise ValueError("duplicates must be assert, ignore or drop")
    long = df.select("read_id", "table_ord", F.inline("insertions"))
    if duplicates == "assert":
        if long.groupBy("read_id", "position", "loc").count().where("count > 1").limit(1).count():
            raise ValueError("insertions of a read occur in more than one table")
        return df
    first = F.row_number().over(Window.partitionBy("read_id", "position", "loc").orderBy("table_ord"))
    kept = long.withColumn("__n", first).where("__n = 1").groupBy("read_id", "table_ord").agg(
        F.sort_array(F.collect_list(F.struct("position", "loc", "base", "q"))).alias("__kept"))  # a read's own insertions
    return df.join(kept, ["read_id", "table_ord"], "left").withColumn("insertions", F.coalesce("__kept", F.array().cast(INSERTIONS))).drop("__kept")


def overlay(tables: list[tuple[DataFrame, TableInfo]], *, duplicates="assert") -> tuple[DataFrame, TableInfo]:
    """Reads by id over the union of positions; where tables overlap, the later one counts."""
    infos = [i for _, i in tables]
    first, last = _window(infos)
    out = None
    for n, (df, i) in enumerate(tables):
        mine = _widened(df, i, first, last, n)
        if out is None:
            out = mine
            continue
        a, b = i.first - first + 1, i.last - i.first + 1

        def patch(c, a=a, b=b):
            old, new = F.col(f"l.{c}"), F.col(f"r.{c}")
            return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(
                F.concat(F.substring(old, 1, a - 1), F.substring(new, a, b), F.substring(old, a + b, last - first + 1))).alias(c)

        both = F.concat(F.coalesce("l.insertions", F.array().cast(INSERTIONS)), F.coalesce("r.insertions", F.array().cast(INSERTIONS)))
        keys = F.transform(both, lambda x: F.struct(x["position"], x["loc"]))
        if duplicates == "assert":
            both = F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.raise_error(F.lit("insertions of a read occur in more than one table")).cast(INSERTIONS)).otherwise(both)
        elif duplicates == "drop":
            both = F.filter(both, lambda x, j: F.array_position(keys, F.struct(x["position"], x["loc"])) == j + 1)
        out = out.alias("l").join(mine.alias("r"), F.col("l.read_id") == F.col("r.read_id"), "full_outer").select(
            F.coalesce("l.table_ord", "r.table_ord").alias("table_ord"), F.coalesce("l.read_id", "r.read_id").alias("read_id"), F.coalesce("l.read_ord", "r.read_ord").alias("read_ord"),
            patch("seq"), patch("qual"), both.alias("insertions"))
    return out.drop("table_ord"), _info(infos, first, last)
