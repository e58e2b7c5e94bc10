"""Constants, alphabets and table metadata of aligned reads.

A read table is a DataFrame with one row per read: ``read_id``, ``read_ord``, ``seq`` and,
where known, ``qual`` (ASCII, ``phred`` above zero) and ``insertions``
(array of position, loc, base, q).  All ``seq`` of a table have the same length and begin
at ``TableInfo.first``; other columns are metadata and pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

INSERTIONS = "array<struct<position:int,loc:int,base:string,q:int>>"

# Gap and fill characters.
EDGE, DELETION, SKIP = "$", "-", "."
NULL_QUALITY = "!"
FILL = {"NT": "N", "AA": "X"}

# Alphabets, IUPAC codes and CIGAR operations.
DNA = "ACGT"
AMINO = "ACDEFGHIKLMNPQRSTVWY"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
CIGAR_OPS = "MIDNSHP=XB"
TRANSITIONS = frozenset({("A", "G"), ("G", "A"), ("C", "T"), ("T", "C")})

# Side chains of residues (name, class, Kyte-Doolittle hydropathy) and colours of bases.
RESIDUES = {
    "A": ("Alanine", "nonpolar", 1.8), "C": ("Cysteine", "polar", 2.5), "D": ("Aspartate", "negative", -3.5), "E": ("Glutamate", "negative", -3.5),
    "F": ("Phenylalanine", "nonpolar", 2.8), "G": ("Glycine", "nonpolar", -0.4), "H": ("Histidine", "positive", -3.2), "I": ("Isoleucine", "nonpolar", 4.5),
    "K": ("Lysine", "positive", -3.9), "L": ("Leucine", "nonpolar", 3.8), "M": ("Methionine", "nonpolar", 1.9), "N": ("Asparagine", "polar", -3.5),
    "P": ("Proline", "nonpolar", -1.6), "Q": ("Glutamine", "polar", -3.5), "R": ("Arginine", "positive", -4.5), "S": ("Serine", "polar", -0.8),
    "T": ("Threonine", "polar", -0.7), "V": ("Valine", "nonpolar", 4.2), "W": ("Tryptophan", "nonpolar", -0.9), "Y": ("Tyrosine", "polar", -1.3),
}
BASE_COLOURS = {"A": "green", "C": "blue", "G": "orange", "T": "red"}


@dataclass(frozen=True)
class TableInfo:
    """What holds for a whole read table."""

    seq_type: str = "NT"
    first: int = 1
    last: int = 0
    phred: int = 33
    null_qual: str = NULL_QUALITY
    has_quality: bool = True
    has_insertions: bool = False
    references: tuple = ()
    user: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.seq_type not in FILL:
            raise ValueError(f"seq_type must be NT or AA, not {self.seq_type!r}")

    @property
    def fill(self) -> str:
        return FILL[self.seq_type]

    @property
    def positions(self) -> list[int]:
        return list(range(self.first, self.last + 1))

    def having(self, **changes) -> TableInfo:
        return replace(self, **changes)
