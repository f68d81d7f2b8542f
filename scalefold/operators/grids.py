"""Scale grids and the q grid (M1, M2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalefold.session import local_table

# Q runs from -8 to 8 in steps of 0.2, with an exact zero.
Q_GRID = [(k - 40) / 5.0 for k in range(81)]

# Parameters of the log-spaced grids (smallest scale, number of scales).
STRAIN_GRID = (8, 4 * 16384 / 16, 20)
LINES_FROM, LINES_MAX, LINES_COUNT = 4, 500, 15
WHOLE_FROM, WHOLE_COUNT = 8, 15
# Samples the published index uses of a series (``head=`` of ``whole_spectra``).
WHOLE_HEAD = 6144


def log_scales(first: float, last: float, count: int) -> list[int]:
    """Log-spaced scales cut to integers, duplicates kept: they weight the regression."""
    return [int(s) for s in np.logspace(np.log10(first), np.log10(last), count).astype(int)]


def lines_scales(n: int) -> list[int]:
    top = min(n // 4, LINES_MAX)
    return log_scales(LINES_FROM, top, LINES_COUNT) if top >= 1 else []


def whole_scales(n: int) -> list[int]:
    """Grid of a whole series or its head."""
    top = n // 8
    return [s for s in log_scales(WHOLE_FROM, top, WHOLE_COUNT) if s > 4] if top >= 1 else []


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def whole_grid(n: pd.Series) -> pd.Series:
    """``whole_scales`` by series length, for one row a series."""
    made = {k: whole_scales(int(k)) for k in n.unique()}
    return n.map(made)


def lines_grid(spark: SparkSession) -> DataFrame:
    rows = [(top, lines_scales(4 * top)) for top in range(1, LINES_MAX + 1)]
    return local_table(spark, rows, "top int, scales array<int>")
