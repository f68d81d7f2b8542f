"""Guarded statistics that Spark's own functions do not cover."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pearson(x: Column, y: Column) -> Column:
    """C1. Pearson correlation over rows where both sides are known; NULL if a side is constant."""
    a = F.when(y.isNotNull(), x)
    b = F.when(x.isNotNull(), y)
    return F.when(
        F.count(F.when(x.isNotNull(), y)) >= 2,
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)),
    )


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """A4. 2 * (1 - Phi(|z|)), one value per series."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")
