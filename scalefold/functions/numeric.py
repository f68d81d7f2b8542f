"""Column expressions for cleaning numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped around a number (P1), and the null tokens.
WRAPPERS = "=\"' "
WRAPPERS_SHORT = '="'
NA_TOKENS = ["", "nan", "NaN", '"', " "]
NA_TOKENS_SHORT = ["", "nan", "NaN", '"']

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities, the value otherwise."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def parse_number(c: Column, wrappers: str = WRAPPERS) -> Column:
    """P1. Strip wrapper characters, then cast; whatever is not a plain number is NULL."""
    bare = F.btrim(c, F.lit(wrappers))
    return finite(F.when(bare.rlike(NUMBER), bare.try_cast("double")))


def null_tokens(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(tokens), c)


def soft_threshold(c: Column, t: Column) -> Column:
    """D4. Shrink towards zero by ``t``."""
    return F.signum(c) * F.greatest(F.abs(c) - t, F.lit(0.0))


def round6(c: Column) -> Column:
    return F.round(c, 6)
