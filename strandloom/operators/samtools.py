"""Alignments before projection: read filtering, mates, and the usual alignment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import scalar as S

# Reasons in the order in which they are tried.
REASONS = ("invalid_hit", "phix", "flag", "indel", "cigar")


def reason(ignore_hits=(), phix=True, indels=True, forbidden=(4, 512)) -> Column:
    """Why a read is left out, or null."""
    name = F.coalesce(F.col("rname"), F.lit(""))
    out = F.when(name.isin("", "*", *ignore_hits), "invalid_hit")
    if phix:
        out = out.when(F.lower(name).startswith("phix"), "phix")
    if forbidden:
        out = out.when(S.has_flags("flag", forbidden), "flag")
    if indels:
        out = out.when(F.col("cigar").rlike("[ID]"), "indel")
    return out.when(F.col("cigar").rlike("[HP=XN]"), "cigar")


def examined(df: DataFrame, **options) -> DataFrame:
    """``df`` with error, read (R1/R2), nterminal_clip, cterminal_clip and pos_end."""
    lead, trail = S.leading_clip("cigar"), S.trailing_clip("cigar")
    return df.withColumns({"error": reason(**options), "read": S.read_number("flag"), "nterminal_clip": lead, "cterminal_clip": trail,
                           "pos_end": F.col("pos") + F.length("seq") - lead - trail - 1})


def filtered(df: DataFrame, debug: str | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, bad, stats): reads without and with a reason, and how many have each; good reads by header and read."""
    e = examined(df, **options)
    bad = e.where("error is not null")
    if debug:
        bad.where("error = 'cigar'").select("header", "flag", "rname", "pos", "cigar", "error").write.option("sep", "\t").mode("overwrite").csv(debug)
    stats = e.groupBy(F.coalesce("error", F.lit("good")).alias("reason")).agg(F.count("*").alias("reads"))
    return e.where("error is null").drop("error").orderBy("header", "read"), bad, stats


def mates(df: DataFrame) -> DataFrame:
    """(header, r1, r2): the two reads of a header side by side."""
    row = F.struct("rname", "pos", "cigar", "seq")
    n = S.read_number("flag")
    return df.groupBy("header").agg(F.min(F.when(n == "R1", row)).alias("r1"), F.min(F.when(n == "R2", row)).alias("r2"))


def flagstat(df: DataFrame) -> DataFrame:
    """(metric, passed, failed): counts of reads by flag, for those that pass and fail quality control."""
    f = F.col("flag")

    def on(bit):
        return f.bitwiseAND(bit) != 0

    def off(bit):
        return f.bitwiseAND(bit) == 0

    primary = off(0x900)
    paired = primary & on(1)
    both = paired & off(4) & off(8)
    away = both & ~F.col("rnext").isin("=", "*") & (F.col("rnext") != F.col("rname"))
    metrics = {
        "total": F.lit(True), "secondary": on(0x100), "supplementary": on(0x800) & off(0x100), "duplicates": on(0x400), "mapped": off(4), "paired": paired, "read1": paired & on(0x40), "read2": paired & on(0x80),
        "properly_paired": paired & on(2) & off(4), "with_mate_mapped": both, "singletons": paired & off(4) & on(8), "mate_elsewhere": away, "mate_elsewhere_mapq5": away & (F.col("mapq") >= 5),
    }
    fail = on(0x200)
    one = df.agg(*(F.count_if(c & (fail if bad else ~fail)).alias(f"{k}{int(bad)}") for k, c in metrics.items() for bad in (False, True)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}0").alias("passed"), F.col(f"{k}1").alias("failed")) for k in metrics))))


def idxstats(df: DataFrame) -> DataFrame:
    """(rname, mapped, unmapped)."""
    up = F.col("flag").bitwiseAND(4) == 0
    return df.groupBy("rname").agg(F.count_if(up).alias("mapped"), F.count_if(~up).alias("unmapped"))


def spans(df: DataFrame) -> DataFrame:
    """(rname, a, b): stretches of reference positions that mapped reads cover, gaps cut out."""
    ops = S.cigar_ops("cigar")
    start = F.struct(F.col("pos").cast("int").alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))
    walk = F.aggregate(ops, start, lambda s, x: F.when(x["op"].isin("M", "=", "X"), F.struct((s["at"] + x["n"]).alias("at"), F.concat(s["done"], F.array(F.struct(s["at"].alias("a"), (s["at"] + x["n"] - 1).alias("b")))).alias("done")))
                       .when(x["op"].isin("D", "N"), F.struct((s["at"] + x["n"]).alias("at"), s["done"].alias("done"))).otherwise(s))
    return df.where(F.col("flag").bitwiseAND(0x704) == 0).where("cigar <> '*'").select("rname", F.inline(walk["done"]))


def depth(df: DataFrame) -> DataFrame:
    """(rname, position, depth): reads over each covered position, from +1/-1 events, so long reads aren't exploded."""
    s = spans(df)
    events = s.select("rname", F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("d")))))
    events = events.groupBy("rname", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("rname").orderBy("at")
    run = events.withColumns({"depth": F.sum("d").over(w), "to": F.lead("at").over(w)}).where("depth > 0")
    return run.select("rname", F.explode(F.sequence("at", F.col("to") - 1)).alias("position"), "depth")


def bed_coverage(df: DataFrame, regions: DataFrame, bin_width: int = 1000) -> DataFrame:
    """(rname, start, stop, bases) for regions [start, stop): an interval join on bins, so it stays an equi-join."""
    s = spans(df).groupBy("rname", "a", "b").agg(F.count("*").alias("times")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / bin_width), F.floor(F.col("b") / bin_width))))
    r = regions.select("rname", "start", "stop").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("stop") - 1) / bin_width))))
    lo = F.greatest("a", "start", F.col("bin") * bin_width)
    hi = F.least(F.col("b") + 1, "stop", (F.col("bin") + 1) * bin_width)
    hit = r.join(s, ["rname", "bin"]).withColumn("n", (hi - lo) * F.col("times")).where("n > 0").groupBy("rname", "start", "stop").agg(F.sum("n").alias("bases"))
    return regions.select("rname", "start", "stop").join(hit, ["rname", "start", "stop"], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))


def without_duplicates(df: DataFrame) -> DataFrame:
    """Of reads at one place and strand, the one of best mapping quality (then the least header); partial sums shrink common places before the shuffle."""
    best = F.min_by(F.struct(*df.columns), F.struct(-F.col("mapq"), F.col("header"))).alias("best")
    return df.groupBy("rname", "pos", F.col("flag").bitwiseAND(16).alias("strand")).agg(best).select("best.*")


def pileup(df: DataFrame) -> DataFrame:
    """(rname, position, depth, bases): of projected letters (rname, position, base), each place's letters as structs of n and base, most frequent first."""
    n = df.groupBy("rname", "position", "base").agg(F.count("*").alias("n"))
    return n.groupBy("rname", "position").agg(F.sum("n").alias("depth"), F.sort_array(F.collect_list(F.struct("n", "base")), asc=False).alias("bases"))  # an alphabet at most


def fill_mates(df: DataFrame) -> DataFrame:
    """rnext, pnext and tlen (outer ends, negative for the later mate, 0 across references) from the mate of the same header."""
    w = Window.partitionBy("header").orderBy("read")
    e = df.withColumns({"read": S.read_number("flag"), "__end": F.col("pos") + F.greatest(S.cigar_total("cigar", "MDN=X"), F.lit(1)) - 1})
    mine = F.struct("rname", "pos", "__end")
    e = e.withColumn("__m", F.coalesce(F.lead(mine).over(w), F.lag(mine).over(w)))
    m = F.col("__m")
    outer = F.greatest(F.col("__end"), m["__end"]) - F.least(F.col("pos"), m["pos"]) + 1
    first = (F.col("pos") < m["pos"]) | ((F.col("pos") == m["pos"]) & (F.col("read") == "R1"))
    return e.withColumns({"rnext": F.when(m.isNull(), "*").when(m["rname"] == F.col("rname"), "=").otherwise(m["rname"]), "pnext": F.coalesce(m["pos"], F.lit(0)),
                          "tlen": F.when(m.isNull() | (m["rname"] != F.col("rname")), 0).otherwise(F.when(first, outer).otherwise(-outer)).cast("int")}).drop("__m", "read", "__end")


def stats(df: DataFrame) -> DataFrame:
    """(metric, value): sequences, letters, mapped letters and mean quality of primary alignments."""
    up = F.col("flag").bitwiseAND(4) == 0
    quality = F.aggregate(S.letters("qual"), F.lit(0), lambda a, c: a + F.ascii(c) - 33)
    one = df.where(F.col("flag").bitwiseAND(0x900) == 0).agg(
        F.count("*").cast("double").alias("sequences"), F.sum(F.length("seq")).cast("double").alias("letters"), F.count_if(up).cast("double").alias("mapped"),
        F.sum(F.when(up, S.cigar_total("cigar", "MI=X"))).cast("double").alias("letters_mapped"), F.max(F.length("seq")).cast("double").alias("longest"),
        F.try_divide(F.sum(quality).cast("double"), F.sum(F.length("qual")).cast("double")).alias("mean_quality"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns))))


def split_by(df: DataFrame, column: str, path: str) -> None:
    """One folder of SAM-like rows for each value of ``column``, say the reference or a read group tag."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def with_read_group(df: DataFrame, group: str) -> DataFrame:
    """``df`` whose tags have RG = ``group``."""
    tags = F.col("tags") if "tags" in df.columns else F.create_map().cast("map<string,string>")
    return df.withColumn("tags", F.map_concat(F.map_filter(tags, lambda k, _: k != "RG"), F.create_map(F.lit("RG"), F.lit(group))))


def by_coordinate(df: DataFrame) -> DataFrame:
    """Alignments by reference and position, unplaced ones last; a range sort."""
    return df.orderBy(F.col("rname") == "*", "rname", "pos", "header")


def to_fastq(df: DataFrame) -> DataFrame:
    """(header, seq, qual) as sequenced: reads of the reverse strand are turned back; secondary records are left out."""
    back = F.col("flag").bitwiseAND(16) != 0
    return df.where(F.col("flag").bitwiseAND(0x900) == 0).select(
        "header", F.when(back, S.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def unaligned(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """Reads whose header has no mapped alignment, say to a control genome."""
    return reads.join(alignments.where(F.col("flag").bitwiseAND(4) == 0).select("header"), "header", "left_anti")


def mismatch_tag(df: DataFrame, reference: str) -> DataFrame:
    """``df`` with nm: mismatches, inserted and deleted letters of each alignment against one reference sequence."""
    start = F.struct(F.lit(0).alias("s"), F.col("pos").cast("int").alias("r"), F.lit(0).alias("nm"))
    ref = F.lit(reference)

    def step(a, x):
        miss = F.size(F.filter(F.zip_with(S.letters(F.substring(F.col("seq"), a["s"] + 1, x["n"])), S.letters(F.substring(ref, a["r"], x["n"])), lambda p, q: p != q), lambda v: v))
        move = lambda s, r, n: F.struct((a["s"] + s).alias("s"), (a["r"] + r).alias("r"), (a["nm"] + n).alias("nm"))
        zero = F.lit(0)
        return F.when(x["op"].isin("M", "=", "X"), move(x["n"], x["n"], miss)).when(x["op"] == "I", move(x["n"], zero, x["n"])).when(x["op"] == "D", move(zero, x["n"], x["n"])).when(
            x["op"] == "N", move(zero, x["n"], zero)).when(x["op"] == "S", move(x["n"], zero, zero)).otherwise(a)

    return df.withColumn("nm", F.aggregate(S.cigar_ops("cigar"), start, step)["nm"])


def fetch(fasta: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, start, stop, seq): stretches of sequences, positions from 1, both ends included."""
    return regions.join(fasta, "id").select("id", "start", "stop", F.expr("substring(seq, start, stop - start + 1)").alias("seq"))


def dictionary(fasta: DataFrame) -> DataFrame:
    """(id, length, md5) of each sequence."""
    return fasta.select("id", F.length("seq").alias("length"), F.md5(F.upper("seq")).alias("md5"))
