"""Seeded draws from a hash of the row's key (B2).

A draw depends on its key alone, so a retried task or another partitioning
gives the same number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, purpose: str, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[c.cast("string") for c in cols])


def uniform(key: Column) -> Column:
    """Uniform on [0, 1) with 32 bits taken from the key's MD5."""
    word = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return word.cast("double") / F.lit(4294967296.0)


def gaussian(key: Column) -> Column:
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    u1 = uniform(F.concat(key, F.lit("|a")))
    u2 = uniform(F.concat(key, F.lit("|b")))
    return F.sqrt(F.lit(-2.0) * F.ln(u1 + F.lit(2.0**-33))) * F.cos(F.lit(2.0 * math.pi) * u2)


#: Rounds of the keyed permutation.
SWAPS = 24


def permuted(place: Column, n: Column, seed: int, purpose: str, *parts: Column | str) -> Column:
    """Where a keyed permutation of 0 .. n - 1 puts ``place``: a sample of any size without looking at the others.

    Each round pairs every x with K - x (mod n), K drawn for the round, and a draw for the pair says whether the
    two change places. That is one to one for any n, so the first k places give k different ones.
    """

    def round_(x: Column, r: Column) -> Column:
        shift = F.floor(uniform(draw_key(seed, purpose, *parts, F.lit("shift"), r)) * n).cast("bigint")
        other = F.pmod(shift - x, n)
        swap = uniform(draw_key(seed, purpose, *parts, F.lit("swap"), r, F.greatest(x, other))) < 0.5
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), place.cast("bigint"), round_)
