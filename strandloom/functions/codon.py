"""Codons, translation, degenerate codes and residue numbering."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.scalar import col
from strandloom.schema import IUPAC

# The standard code, codons in the order of their letters T, C, A, G.
_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_STANDARD = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), _RESIDUES, strict=True))


def codon_table() -> dict[str, str]:
    """All codons over ACGTN: one residue if every reading of N agrees, else X."""
    out = {}
    for codon in product("ACGTN", repeat=3):
        found = {_STANDARD["".join(c)] for c in product(*(IUPAC[x] for x in codon))}
        out["".join(codon)] = found.pop() if len(found) == 1 else "X"
    return out


def codons(seq, frame: int = 0, pad: bool = False) -> Column:
    """Codons from ``frame`` on; a last part is dropped, or padded with N."""
    s = F.substring(F.upper(col(seq)), frame + 1, 1 << 30)
    if pad:
        s = F.concat(s, F.repeat(F.lit("N"), F.pmod(-F.length(s), F.lit(3))))
    n = F.expr("1") * F.floor(F.length(s) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(s, i * 3 + 1, 3))).otherwise(F.array().cast("array<string>"))


def translate(seq, frame: int = 0, pad: bool = False) -> Column:
    """Residues; an unknown codon is an error."""
    table = F.create_map(*(F.lit(x) for pair in codon_table().items() for x in pair))
    return F.array_join(F.transform(codons(seq, frame, pad), lambda c: F.coalesce(
        F.try_element_at(table, c), F.raise_error(F.concat(F.lit("unknown codon "), c)).cast("string"))), "")


def shift(nt_pos, residue_shift: int) -> Column:
    """Nucleotide position after a shift by residues; positions below 1 are an error."""
    p = col(nt_pos)
    return _from_one(p) + (residue_shift - 1) * 3


def _from_one(p: Column) -> Column:
    return F.when(p < 1, F.raise_error(F.lit("position below 1")).cast("long")).otherwise(p)


def residue_number(nt_pos, residue_shift: int | None = None) -> Column:
    """struct(residue from 1, nt_pos, offset in the codon); positions below 1 are an error."""
    given = _from_one(col(nt_pos))
    p = shift(given, residue_shift) if residue_shift else given  # no shift, or one of 0
    return F.struct((F.floor((p - 1) / 3) + 1).cast("long").alias("residue"), p.alias("nt_pos"), F.pmod(p - 1, F.lit(3)).alias("codon_offset"))


def degenerate_regex(seq: str) -> str:
    """A pattern that matches every reading of a degenerate sequence."""
    return "".join(c if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in seq.upper())


def library_alignment(actual: str, library: str) -> dict:
    """Where a degenerate library lies in a sequence: start (from 0), the letters there, and 0/1 vectors of
    nucleotides and residues that the library varies."""
    found = re.search(degenerate_regex(library), actual.upper())
    if not found:
        raise ValueError("the library doesn't occur in the sequence")
    nt = [0] * len(actual)
    for i, c in enumerate(library.upper()):
        nt[found.start() + i] = int(len(IUPAC[c]) > 1)
    residues = [int(any(nt[i : i + 3])) for i in range(0, len(actual) - 2, 3)]
    return {"start": found.start(), "sequence": found.group(), "nt": nt, "residues": residues}


LIBRARY_PARTS = 6


def library_definition(entries: list[tuple[str, str]]) -> dict[str, str]:
    """The named sequences of a library file."""
    if len(entries) != LIBRARY_PARTS:
        raise ValueError(f"a library has {LIBRARY_PARTS} entries, not {len(entries)}")
    return {name: seq.upper() for name, seq in entries}
