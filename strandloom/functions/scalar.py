"""Column builders: letters, qualities, flags, CIGAR strings.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def letters(seq) -> Column:
    return F.split(col(seq), "")


def phred(qual, adjust: int = 33) -> Column:
    """Quality characters as numbers."""
    return F.transform(F.split(col(qual), ""), lambda c: F.ascii(c) - adjust)


def phred_string(values, adjust: int = 33) -> Column:
    return F.array_join(F.transform(col(values), lambda q: F.char(q + adjust)), "")


def flag_bits(flag) -> Column:
    """Numbers of the set bits of a SAM flag, ascending."""
    return F.filter(F.array(*(F.lit(i) for i in range(12))), lambda i: F.getbit(col(flag), i) == 1)


def flag_text(flag) -> Column:
    return F.array_join(F.transform(flag_bits(flag), lambda i: i.cast("string")), ",")


def read_number(flag) -> Column:
    return F.when(col(flag).bitwiseAND(16) == 0, "R1").otherwise("R2")


def has_flags(flag, bits) -> Column:
    """Any of the flag values in ``bits`` is set."""
    return col(flag).bitwiseAND(sum(set(bits))) != 0


def number(text: Column, pattern: str) -> Column:
    """A number that ``pattern`` captures, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def leading_clip(cigar) -> Column:
    return number(col(cigar), r"^(\d+)S")


def trailing_clip(cigar) -> Column:
    return number(col(cigar), r"(\d+)S$")


def base_hits(cigar) -> Column:
    """Length of the first match."""
    return number(col(cigar), r"(\d+)M")


def cigar_ops(cigar) -> Column:
    """array<struct<n int, op string>>; an invalid CIGAR gives an empty array."""
    c = col(cigar)
    pattern = r"(\d+)([MIDNSHP=XB])"
    ops = F.zip_with(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)),
                     lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))
    return F.when(c.rlike(r"^(\d+[MIDNSHP=XB])+$"), ops).otherwise(F.filter(ops, lambda _: F.lit(False)))


def cigar_total(cigar, ops: str) -> Column:
    """Summed lengths of the operations in ``ops``."""
    chosen = F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops))
    return F.aggregate(chosen, F.lit(0), lambda a, x: a + x["n"])


def cut(seq: Column, first: int, start: int, end: int) -> Column:
    """Letters at positions ``start`` to ``end`` of a string that begins at position ``first``."""
    return F.substring(seq, start - first + 1, end - start + 1)


def strip_clips(seq, qual, cigar, width: int, fill: str = "N", null: str = "!") -> tuple[Column, Column]:
    """Sequence and quality without soft clips, padded to ``width``."""
    lead, trail = leading_clip(cigar), trailing_clip(cigar)

    def one(c, pad):
        body = F.substring(c, lead + 1, F.length(c) - lead - trail)
        return F.concat(body, F.repeat(F.lit(pad), F.greatest(F.lit(width) - F.length(body), F.lit(0))))

    return one(col(seq), fill), one(col(qual), null)


def one_hot(seq, alphabet: str = "ACGT") -> Column:
    """For each letter an array with a 1 at its place in ``alphabet``."""
    return F.transform(letters(seq), lambda c: F.array(*((c == a).cast("int") for a in alphabet)))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


# Fixed value: the canonical form of public version identifiers (PEP 440).
_VERSION = r"^([1-9][0-9]*!)?(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*((a|b|rc)(0|[1-9][0-9]*))?(\.post(0|[1-9][0-9]*))?(\.dev(0|[1-9][0-9]*))?$"


def canonical_version(version) -> Column:
    return col(version).rlike(_VERSION)


def overlaps(rname: str, first: int, last: int, cigar="cigar") -> Column:
    """Whether an alignment covers any reference position from ``first`` to ``last``."""
    return (F.col("rname") == rname) & (F.col("pos") <= last) & (F.col("pos") + F.greatest(cigar_total(cigar, "MDN=X"), F.lit(1)) - 1 >= first)
