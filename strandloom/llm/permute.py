"""Keyed pseudorandom permutations of 0..n-1 as Spark expressions.

A mixed-radix Feistel network permutes a*b >= n values, a and b near the root of n;
values outside the domain walk along their cycle until they are inside.  At most a-1
values lie outside, so a walk beyond 64 steps can't happen below n = 4096 and has a
chance under n**-32 above; it would raise, never give a wrong slot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WALK = 64


def _round(value: Column, keys: list[Column], i: int, size: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(i), value), size)


def _once(x: Column, a: Column, b: Column, keys: list[Column], rounds: int) -> Column:
    left, right = (x - F.pmod(x, b)) / b, F.pmod(x, b)
    left = left.cast("long")
    for i in range(rounds):
        if i % 2:
            right = F.pmod(right + _round(left, keys, i, b), b)
        else:
            left = F.pmod(left + _round(right, keys, i, a), a)
    return left * b + right


def permuted(x: Column, n: Column | int, *keys, rounds: int = 4) -> Column:
    """The place of ``x`` (0 <= x < n) under the permutation chosen by ``keys``."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    keys = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")
    x = x.cast("long")
    first = _once(x, a, b, keys, rounds)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)),
        first,
        lambda y, _: F.when(y < n, y).otherwise(_once(y, a, b, keys, rounds)),
    )
    return F.when(first < n, first).otherwise(
        F.when(walk < n, walk).otherwise(F.raise_error(F.lit("permutation walk too long")).cast("long"))
    )
