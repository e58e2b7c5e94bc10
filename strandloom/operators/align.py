"""From alignments to fixed-width rows on reference coordinates.

CIGAR walks are folded inside the row (no explode, no shuffle); only the window, where
it isn't given, takes one aggregate over the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.schema import DELETION, EDGE, INSERTIONS, NULL_QUALITY, SKIP

_STATE = f"struct<s:int,r:int,o:string,q:string,ins:{INSERTIONS}>"


def extent(df: DataFrame, *, seq="seq", pos="pos", cigar: str | None = "cigar") -> tuple[int, int] | None:
    """Least and largest reference position, or None for no rows."""
    span = F.length(seq)
    if cigar:
        span = span + S.cigar_total(cigar, "DN") - S.cigar_total(cigar, "IS")
        df = df.where(F.col(cigar) != "*")
    lo, hi = df.agg(F.min(pos), F.max(F.col(pos) + span - 1)).first()
    return None if lo is None else (int(lo), int(hi))


def project(df: DataFrame, *, seq="seq", qual: str | None = "qual", pos="pos", cigar="cigar", first: int | None = None,
            last: int | None = None, phred: int = 33, edge=EDGE, null=NULL_QUALITY) -> tuple[DataFrame, int, int]:
    """Replace ``seq`` and ``qual`` by their projection on [first, last] and add ``insertions``.

    M, = and X copy; D and N write gaps; S is skipped; H and P do nothing; B is an error.
    An insertion belongs to the reference base on its right; its letters are numbered
    -1, -2, ... from that base leftwards.  Reads outside the window become all edge.
    """
    df = df.where(F.col(cigar) != "*")
    if first is None or last is None:
        lo, hi = extent(df, seq=seq, pos=pos, cigar=cigar) or (1, 0)
        first, last = lo if first is None else first, hi if last is None else last
    if first > last + 1:
        raise ValueError("the window ends before it begins")
    width = last - first + 1
    quality = f"`{qual}`" if qual else "cast(null as string)"
    one = f"ascii(substring({quality}, a.s + i + 1, 1)) - {phred}"
    walk = f"""aggregate(__ops, cast(named_struct('s', 0, 'r', `{pos}`, 'o', '', 'q', '', 'ins', array()) as {_STATE}), (a, x) ->
      case
        when x.op in ('M', '=', 'X') then named_struct('s', a.s + x.n, 'r', a.r + x.n, 'o', a.o || substring(`{seq}`, a.s + 1, x.n),
             'q', a.q || coalesce(substring({quality}, a.s + 1, x.n), ''), 'ins', a.ins)
        when x.op in ('D', 'N') then named_struct('s', a.s, 'r', a.r + x.n, 'o', a.o || repeat(if(x.op = 'D', '{DELETION}', '{SKIP}'), x.n),
             'q', a.q || repeat('{null}', x.n), 'ins', a.ins)
        when x.op = 'S' then named_struct('s', a.s + x.n, 'r', a.r, 'o', a.o, 'q', a.q, 'ins', a.ins)
        when x.op = 'I' then named_struct('s', a.s + x.n, 'r', a.r, 'o', a.o, 'q', a.q, 'ins',
             if(a.r between {first} and {last}, concat(a.ins, transform(sequence(0, x.n - 1), i ->
                named_struct('position', a.r, 'loc', i - x.n, 'base', substring(`{seq}`, a.s + i + 1, 1), 'q', {one}))), a.ins))
        when x.op = 'B' then cast(raise_error('CIGAR operation B') as {_STATE})
        else a
      end)"""
    ops = F.filter(S.cigar_ops(cigar), lambda x: x["n"] > 0)
    w = df.withColumn("__ops", ops).withColumn(pos, F.col(pos).cast("int")).withColumn("__w", F.expr(walk))

    def fit(body, pad):
        left = F.repeat(F.lit(pad), F.greatest(F.col(pos) - first, F.lit(0)))
        inner = F.substring(body, F.greatest(F.lit(first) - F.col(pos), F.lit(0)) + 1, F.lit(1 << 30))
        return F.substring(F.rpad(F.concat(left, inner), F.greatest(F.length(left) + F.length(inner), F.lit(width)), pad), F.lit(1), F.lit(width))

    made = {seq: fit(F.col("__w.o"), edge), "insertions": F.col("__w.ins")}
    if qual:
        made[qual] = F.when(F.col(qual).isNotNull(), fit(F.col("__w.q"), null))
    return w.withColumns(made).drop("__ops", "__w"), first, last


def place(df: DataFrame, *, seq="seq", qual: str | None = "qual", pos="pos", first: int | None = None, last: int | None = None,
          edge=EDGE, null=NULL_QUALITY) -> tuple[DataFrame, int, int]:
    """Put ungapped strings at ``pos`` into [first, last], padded and clipped."""
    if first is None or last is None:
        lo, hi = extent(df, seq=seq, pos=pos, cigar=None) or (1, 0)
        first, last = lo if first is None else first, hi if last is None else last
    width = last - first + 1

    def fit(c, pad):
        left = F.repeat(F.lit(pad), F.greatest(F.col(pos) - first, F.lit(0)).cast("int"))
        inner = F.substring(F.col(c), (F.greatest(F.lit(first) - F.col(pos), F.lit(0)) + 1).cast("int"), F.lit(1 << 30))
        return F.substring(F.rpad(F.concat(left, inner), F.greatest(F.length(left) + F.length(inner), F.lit(width)), pad), F.lit(1), F.lit(width))

    made = {seq: fit(seq, edge)}
    if qual:
        made[qual] = fit(qual, null)
    return df.withColumns(made), first, last


def guess_type(df: DataFrame, seq="seq", rows: int | None = None) -> str:
    """NT or AA, from the letters of all sequences, or of any ``rows`` of them."""
    some = df.select(F.upper(F.col(seq)).alias("s"))
    some = some if rows is None else some.limit(rows)
    used = some.select(F.explode(F.array_distinct(S.letters("s"))).alias("c")).distinct().collect()
    return seq_type_of({r.c for r in used if r.c})


def seq_type_of(letters: set[str]) -> str:
    import warnings

    from strandloom.schema import AMINO, IUPAC

    letters = letters - {EDGE, DELETION}
    if letters <= set("ACGT"):
        return "NT"
    if letters <= set(IUPAC):
        warnings.warn("degenerate bases: taken as NT", stacklevel=2)
        return "NT"
    if not letters <= set(AMINO) | {"*", "X"}:
        warnings.warn("letters of no alphabet: taken as AA", stacklevel=2)
    return "AA"
