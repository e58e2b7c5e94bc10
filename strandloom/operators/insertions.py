"""Statistics of inserted letters.  They are nested in their read, so filtering reads filters them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.dist import bits, checked, frequencies
from strandloom.schema import TableInfo


def exploded(df: DataFrame, info: TableInfo, positions=None, least_quality=None, keep=("read_id",)) -> DataFrame:
    """(…keep, position, loc, base, q), one row per inserted letter."""
    nested = F.col("insertions")
    if positions is not None:
        wanted = checked(info, positions)
        nested = F.filter(nested, lambda i: i["position"].isin(wanted))
    if least_quality is not None:
        nested = F.filter(nested, lambda i: i["q"] >= least_quality)
    return df.select(*keep, F.inline(nested))


def _with_empty(out: DataFrame, info, positions, empty, values):
    if not empty:
        return out
    every = out.sparkSession.createDataFrame([(p,) for p in checked(info, positions)], "position int")
    return every.join(out, "position", "left").na.fill(0, values)


def events(df, info, positions=None, empty=False, least_quality=None) -> DataFrame:
    """(position, reads): reads with an insertion before the position."""
    out = exploded(df, info, positions, least_quality, keep=()).where("loc = -1").groupBy("position").agg(F.count("*").alias("reads"))
    return _with_empty(out, info, positions, empty, ["reads"])


def distribution(df, info, positions=None, empty=False, least_quality=None) -> DataFrame:
    """(position, loc, n): inserted letters."""
    out = exploded(df, info, positions, least_quality, keep=()).groupBy("position", "loc").agg(F.count("*").alias("n"))
    return _with_empty(out, info, positions, empty, ["n"])


def average_quality(df, info, positions=None, empty=False) -> DataFrame:
    """(position, loc, q): mean quality of inserted letters."""
    out = exploded(df, info, positions, keep=()).groupBy("position", "loc").agg(F.avg("q").alias("q"))
    return _with_empty(out, info, positions, empty, ["q"])


def expectation(df, info, positions=None, method="mean", least_quality=None, empty=False) -> DataFrame:
    """(position, loc): mean, median or farthest ('max') place of inserted letters."""
    how = {"mean": F.avg("loc"), "median": F.median("loc"), "max": F.min("loc").cast("double")}
    if method not in how:
        raise ValueError(f"method must be mean, median or max, not {method!r}")
    out = exploded(df, info, positions, least_quality, keep=()).groupBy("position").agg(how[method].alias("loc"))
    return _with_empty(out, info, positions, empty, ["loc"])


def letter_dist(df, info, positions=None, method="counts", least=0) -> DataFrame:
    """(position, loc, letter, value) of inserted letters; '-' counts the reads without one.  Columns with fewer than ``least`` letters go."""
    n = exploded(df, info, positions, keep=()).groupBy("position", "loc", F.col("base").alias("letter")).agg(F.count("*").alias("value"))
    n = n.withColumn("__all", F.sum("value").over(Window.partitionBy("position", "loc"))).where(F.col("__all") >= least)
    reads = df.agg(F.count("*").alias("__reads"))
    gaps = n.select("position", "loc", "__all").distinct().crossJoin(F.broadcast(reads))  # one row
    gaps = gaps.select("position", "loc", F.lit("-").alias("letter"), (F.col("__reads") - F.col("__all")).alias("value"))
    out = n.drop("__all").unionByName(gaps)
    if method == "counts":
        return out
    out = frequencies(out.where("value > 0") if method == "bits" else out, ("position", "loc"))
    if method == "freq":
        return out
    return bits(out, df.count(), out.agg(F.countDistinct("letter")).first()[0], ("position", "loc"))


def _shown(df, info, positions, least, gap, lower):
    """``df`` with __shown: for every base and insertion column, in order, a struct of position, loc, base and q.

    Insertion columns are few, a row of them meets every read; letters are looked up in the read itself."""
    ins = exploded(df, info, positions, keep=()).groupBy("position", "loc").agg(F.count("*").alias("n")).where(F.col("n") > least)
    places = F.array(*(F.struct(F.lit(p).alias("position"), F.lit(0).alias("loc")) for p in checked(info, positions))).cast("array<struct<position:int,loc:int>>")
    columns = ins.agg(F.array_sort(F.concat(places, F.collect_list(F.struct(F.col("position").cast("int").alias("position"), F.col("loc").cast("int").alias("loc"))))).alias("__columns"))
    letter = lambda i: F.struct((F.lower(i["base"]) if lower else i["base"]).alias("base"), i["q"].cast("int").alias("q"))
    have = F.map_from_entries(F.transform("insertions", lambda i: F.struct(F.struct(i["position"].cast("int").alias("position"), i["loc"].cast("int").alias("loc")).alias("key"), letter(i).alias("value"))))
    none = F.struct(F.lit(gap).alias("base"), F.lit(0).alias("q"))

    def at(c):
        i = c["position"] - info.first + 1
        q = F.ascii(F.substring(F.col("qual"), i, F.lit(1))) - info.phred if info.has_quality else F.lit(None).cast("int")
        read = F.struct(F.substring(F.col("seq"), i, F.lit(1)).alias("base"), q.alias("q"))
        found = F.when(c["loc"] == 0, read).otherwise(F.coalesce(F.try_element_at(F.col("__have"), c), none))
        return F.struct(c["position"].alias("position"), c["loc"].alias("loc"), found["base"].alias("base"), found["q"].alias("q"))

    return df.crossJoin(F.broadcast(columns)).withColumn("__have", have).withColumn("__shown", F.transform("__columns", at)).drop("__columns", "__have")  # one row


def view(df, info, positions=None, least=0, gap="-", quality=False, lower=True) -> DataFrame:
    """(read_id, position, loc, base[, q]): base columns, and insertion columns that have over ``least`` letters in all;
    reads without the insertion show ``gap`` with quality 0."""
    out = _shown(df, info, positions, least, gap, lower).select("read_id", F.inline("__shown"))
    return out if quality else out.drop("q")


def strings(df, info, positions=None, least=0, gap="-", lower=True, quality=False, keep=()) -> DataFrame:
    """(read_id, seqs[, quals]): each read with its insertion columns, as one string; no read leaves its row."""
    shown = _shown(df, info, positions, least, gap, lower)
    made = [F.array_join(F.transform("__shown", lambda x: x["base"]), "").alias("seqs")]
    if quality:
        made.append(F.array_join(F.transform("__shown", lambda x: F.char(x["q"] + info.phred)), "").alias("quals"))
    return shown.select("read_id", *keep, *made)
