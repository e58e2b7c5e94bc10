"""SeqTable: a read table and its metadata; every method returns a DataFrame or another SeqTable, lazily."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.operators import align, compare, dist, insertions, logo, merge, quality
from strandloom.schema import EDGE, INSERTIONS, NULL_QUALITY, TableInfo
from strandloom.sources import bam, text

COLUMNS = {"ref": "rname", "seqs": "seq", "quals": "qual", "cigar": "cigar", "pos": "pos"}


class SeqTable:
    def __init__(self, df: DataFrame, info: TableInfo):
        self.df, self.info = df, info

    # sources

    @classmethod
    def from_list(cls, spark: SparkSession, seqs, quals=None, *, pos=1, index=None, seq_type=None, phred=33, null_qual=NULL_QUALITY, ref_name="", user=None) -> SeqTable:
        """Aligned strings from the driver; ragged ones are padded with N or X, qualities with null quality."""
        seqs = list(seqs)
        if quals is not None and [len(s) for s in seqs] != [len(q) for q in quals]:
            raise ValueError("sequences and qualities differ in shape")
        width = max(map(len, seqs), default=0)
        first = pos if isinstance(pos, int) else pos[0]
        if seq_type is None:
            seq_type = align.seq_type_of({c for s in seqs[:1000] for c in s.upper()})
        info = TableInfo(seq_type, first, first + width - 1, phred, null_qual, quals is not None, references=(ref_name,) if ref_name else (), user=user or {})
        ids = list(index) if index is not None else list(range(1, len(seqs) + 1))
        kind = "string" if ids and isinstance(ids[0], str) else "long"
        rows = [(i, n, s.upper().ljust(width, info.fill), None if quals is None else quals[n - 1].ljust(width, null_qual), []) for n, (i, s) in enumerate(zip(ids, seqs, strict=True), 1)]
        return cls(spark.createDataFrame(rows, f"read_id {kind}, read_ord long, seq string, qual string, insertions {INSERTIONS}"), info)

    @classmethod
    def from_packed(cls, df: DataFrame, *, first=1, seq_type=None, phred=33) -> SeqTable:
        """A DataFrame with read_id, seq and perhaps read_ord, qual: ragged strings are padded to the longest."""
        if seq_type is None:
            seq_type = align.guess_type(df)
        width = df.agg(F.max(F.length("seq"))).first()[0] or 0
        has = "qual" in df.columns
        info = TableInfo(seq_type, first, first + width - 1, phred, has_quality=has)
        made = {"seq": F.rpad("seq", width, info.fill), "qual": F.rpad("qual", width, NULL_QUALITY) if has else F.lit(None).cast("string")}
        if "read_ord" not in df.columns:
            made["read_ord"] = F.col("read_id")
        if "insertions" not in df.columns:
            made["insertions"] = F.array().cast(INSERTIONS)
        return cls(df.withColumns(made), info)

    @classmethod
    def from_df(cls, df: DataFrame, seq_type="NT", *, index=None, columns=None, ref_name=None, first=None, last=None, phred=33, edge=EDGE, user=None) -> SeqTable:
        """An alignment-like DataFrame: rows with a null (or '*') anywhere go; with a CIGAR column reads are projected, else placed.

        Reads are named by ``index``, else by their header, with /1 or /2 for mates."""
        names = COLUMNS | (columns or {})
        df = df.withColumnsRenamed({v: COLUMNS[k] for k, v in names.items() if v in df.columns})
        if "pos" not in df.columns:
            warnings.warn("no position column: all reads begin at 1", stacklevel=2)
            df = df.withColumn("pos", F.lit(1))
        star = [c for c, t in df.dtypes if t == "string" and c in ("seq", "qual", "rname", "cigar")]
        df = df.na.drop()
        for c in star:
            df = df.where(F.col(c) != "*")
        has = "qual" in df.columns
        if "cigar" in df.columns:
            df, first, last = align.project(df, qual="qual" if has else None, first=first, last=last, phred=phred, edge=edge)
        else:
            df, first, last = align.place(df, qual="qual" if has else None, first=first, last=last, edge=edge)
            df = df.withColumn("insertions", F.array().cast(INSERTIONS))
        key = index or ("header" if "header" in df.columns else "read_id" if "read_id" in df.columns else None)
        name = F.col(key) if key else F.monotonically_increasing_id() + 1
        if key == "header" and index is None and "flag" in df.columns:  # mates share a header
            name = F.concat(name, F.when(F.col("flag").bitwiseAND(1) == 0, "").when(F.col("flag").bitwiseAND(0x40) != 0, "/1").otherwise("/2"))
        df = df.withColumn("read_id", name)
        if "read_ord" not in df.columns:
            df = df.withColumn("read_ord", F.monotonically_increasing_id() + 1)
        if not has:
            df = df.withColumn("qual", F.lit(None).cast("string"))
        return cls(df, TableInfo(seq_type, first, last, phred, has_quality=has, has_insertions="cigar" in df.columns, references=(ref_name,) if ref_name else (), user=user or {}))

    @classmethod
    def from_sam(cls, spark, path, *, seq_type="NT", first=None, last=None, least_mapq=None, region=None) -> SeqTable:
        return cls._aligned(text.read_sam(spark, path, fields=[f for f in text.SAM_FIELDS]).drop("tags"), seq_type, first, last, least_mapq, region)

    @classmethod
    def from_bam(cls, spark, path, *, seq_type="NT", first=None, last=None, least_mapq=None, region=None) -> SeqTable:
        return cls._aligned(bam.read_bam(spark, path).drop("tags"), seq_type, first, last, least_mapq, region)

    @classmethod
    def _aligned(cls, df, seq_type, first, last, least_mapq, region):
        df = df.where("rname <> '*'")
        if least_mapq is not None:
            df = df.where(F.col("mapq") >= least_mapq)
        if region is not None:
            df = df.where(S.overlaps(*region))
        return cls.from_df(df, seq_type, first=first, last=last)

    def _with(self, df: DataFrame, **changes) -> SeqTable:
        return SeqTable(df, self.info.having(**changes) if changes else self.info)

    # selections

    def where(self, condition: Column) -> SeqTable:
        return self._with(self.df.where(condition))

    def reads(self, ids) -> SeqTable:
        """Reads by id: a list, or a DataFrame with read_id."""
        if isinstance(ids, DataFrame):
            return self._with(self.df.join(ids.select("read_id"), "read_id", "left_semi"))
        return self._with(self.df.where(F.col("read_id").isin(list(ids))))

    def window(self, first: int, last: int) -> SeqTable:
        """Positions ``first`` to ``last``; insertions outside go."""
        a, b = max(first, self.info.first), min(last, self.info.last)
        made = {c: S.cut(F.col(c), self.info.first, a, b) for c in ("seq", "qual")}
        made["insertions"] = F.filter("insertions", lambda i: i["position"].between(a, b))
        return self._with(self.df.withColumns(made), first=a, last=b)

    def ordinal(self, start: int, stop: int) -> SeqTable:
        return self._with(self.df.where(F.col("read_ord").between(start, stop - 1)))

    def subsample(self, n: int, *, replace=False, seed: int | None = None) -> SeqTable:
        """Exactly n reads (all, if there are fewer and none is repeated)."""
        if not replace:
            return self._with(self.df.orderBy(F.rand(seed)).limit(n))
        spark = self.df.sparkSession
        total = self.df.count()
        if not total:
            return self
        numbered, _ = merge.stack([(self.df, self.info)], renumber=True)
        picks = spark.range(n).select((F.floor(F.rand(seed) * total) + 1).cast("long").alias("read_id"))
        return self._with(picks.join(numbered, "read_id"), has_quality=True)

    # views

    def sequences(self) -> DataFrame:
        return self.df.select("read_id", "seq")

    def qualities(self, numeric=True) -> DataFrame:
        return quality.numeric(self.df, self.info) if numeric else self.df.select("read_id", "qual")

    def cells(self, positions=None, quality=False) -> DataFrame:
        return dist.cells(self.df, self.info, positions, quality=quality)

    def one_hot(self) -> DataFrame:
        return self.df.select("read_id", S.one_hot("seq").alias("one_hot"))

    def slices(self, positions=None, *, empty=None, empty_qual=None, with_quality=False, ordered=False) -> DataFrame:
        """(read_id, seqs[, quals]): the letters at ``positions``, in that order, each once.  Positions before and after
        the table become as many ``empty`` letters in front and behind; gaps inside are left out."""
        info = self.info
        asked = list(dict.fromkeys(positions)) if positions is not None else info.positions
        inside = [p for p in asked if info.first <= p <= info.last]
        before, after = sum(p < info.first for p in asked), sum(p > info.last for p in asked)

        def join(c, pad):
            body = F.concat(*(S.cut(F.col(c), info.first, a, b) for a, b in dist.runs(inside))) if inside else F.lit("")
            return F.concat(F.repeat(F.lit(pad), F.lit(before)), body, F.repeat(F.lit(pad), F.lit(after)))

        made = [join("seq", info.fill if empty is None else empty).alias("seqs")]
        if with_quality:
            made.append(join("qual", info.null_qual if empty_qual is None else empty_qual).alias("quals"))
        df = self.df.orderBy("read_ord") if ordered else self.df
        return df.select("read_id", *made)

    def with_insertions(self, **options) -> DataFrame:
        return insertions.view(self.df, self.info, **options)

    def strings_with_insertions(self, **options) -> DataFrame:
        return insertions.strings(self.df, self.info, **options)

    # distributions

    def seq_dist(self, positions=None, method="counts", **options) -> DataFrame:
        return dist.seq_dist(self.df, self.info, positions, method, **options)

    def pos_entropy(self, positions=None, ignore=(), base=2) -> DataFrame:
        return dist.entropy(self.seq_dist(positions, "freq", ignore=ignore), base)

    def diversity(self, positions=None, ignore=()) -> DataFrame:
        return dist.diversity(self.seq_dist(positions, "freq", ignore=ignore))

    def relative_entropy(self, background: SeqTable | None = None, positions=None, ignore=()) -> DataFrame:
        b = background.seq_dist(positions, "freq", ignore=ignore) if background else None
        return dist.relative_entropy(self.seq_dist(positions, "freq", ignore=ignore), self.info, b)

    def plogo(self, background: SeqTable | None = None, positions=None, ignore=(), alpha=0.01, exact=False) -> tuple[DataFrame, float]:
        count = self.seq_dist(positions, ignore=ignore)
        b = background.seq_dist(positions, "freq", ignore=ignore) if background else None
        letters = count.agg(F.countDistinct("letter")).first()[0]
        return logo.plogo(count, self.info, b, exact=exact), logo.significance(alpha, letters * len(dist.checked(self.info, positions)))

    def seq_logo(self, positions=None, method="freq", with_insertions=True, **options) -> DataFrame:
        out = self.seq_dist(positions, method, **options).withColumn("loc", F.lit(0))
        if with_insertions and self.info.has_insertions:
            out = out.unionByName(insertions.letter_dist(self.df, self.info, positions, method).select(out.columns))
        return logo.bars(out)

    def consensus(self, **options) -> DataFrame:
        return dist.consensus(self.df, self.info, **options)

    # insertions

    def insertion_events(self, *a, **k) -> DataFrame:
        return insertions.events(self.df, self.info, *a, **k)

    def insertion_distribution(self, *a, **k) -> DataFrame:
        return insertions.distribution(self.df, self.info, *a, **k)

    def average_insertion_quality(self, *a, **k) -> DataFrame:
        return insertions.average_quality(self.df, self.info, *a, **k)

    def insertion_expectations(self, *a, **k) -> DataFrame:
        return insertions.expectation(self.df, self.info, *a, **k)

    def insertion_seq_dist(self, *a, **k) -> DataFrame:
        return insertions.letter_dist(self.df, self.info, *a, **k)

    # comparisons

    def compare_to_references(self, seqs, positions=None, **options) -> DataFrame:
        return compare.compare(self.df, self.info, seqs, positions, **options)

    def hamming_distance(self, seqs, positions=None, **options) -> DataFrame:
        return compare.hamming(self.df, self.info, seqs, positions, **options)

    def mutation_profile(self, seqs, positions=None, **options) -> DataFrame:
        return compare.mutations(self.df, self.info, seqs, positions, **options)

    def ts_tv_profile(self, seqs, positions=None, **options) -> DataFrame:
        return compare.ts_tv(self.df, self.info, seqs, positions, **options)

    def pwm(self, matrix, **options) -> DataFrame:
        return compare.pwm(self.df, self.info, matrix, **options)

    def substrings(self, k, positions=None, *, subsample=None, weight=None, seed=None, with_insertions=False, **options) -> DataFrame:
        t = self.subsample(subsample, seed=seed) if subsample else self
        count = compare.words_with_insertions if with_insertions else compare.words
        return count(t.df, self.info, k, positions, weight=weight, **options)

    # quality

    def quality_filter(self, q, percent, ignore_null=True) -> SeqTable:
        return self._with(quality.filtered(self.df, self.info, q, percent, ignore_null))

    def low_bases_to_null(self, q, fill=None, **options) -> SeqTable:
        return self._with(quality.masked(self.df, self.info, q, fill, **options))

    def quality_dist(self, bins="even", **options) -> DataFrame:
        return quality.distribution(self.df, self.info, bins, **options)

    def repeated_reads(self, least: int) -> SeqTable:
        """Reads whose sequence occurs more than ``least`` times; sequences are counted before they are joined back."""
        often = self.df.groupBy("seq").agg(F.count("*").alias("__n")).where(F.col("__n") > least).select("seq")
        return self._with(self.df.join(often, "seq", "left_semi"))


def merge_tables(tables: list[SeqTable], *, axis=0, renumber=True, duplicates="assert") -> SeqTable:
    pairs = [(t.df, t.info) for t in tables]
    df, info = merge.stack(pairs, renumber=renumber, duplicates=duplicates) if axis == 0 else merge.overlay(pairs, duplicates=duplicates)
    return SeqTable(df, info)
