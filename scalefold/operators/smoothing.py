"""Edge-padded smoothing of ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalefold.operators.indexing import Keys, with_halo

# Quadratic smoothing weights over 11 samples, and their sum.
QUAD_WEIGHTS = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]
QUAD_SUM = 429
BLOCK = 65_536


def _over_neighbours(df: DataFrame, keys: Keys, reach: int, bounded: bool, value: Column) -> DataFrame:
    """Evaluate ``value`` per row within its group, or within overlapping blocks of a long series.

    A block holds ``reach`` rows of each neighbour, so a window that comes up
    short means the series itself ends there.
    """
    if bounded:
        return df.withColumn("value", value)
    split = with_halo(df, BLOCK, reach)
    return split.withColumn("value", value).filter("_own").drop("_block", "_own")


def _whole(w, reach: int, total: Column) -> Column:
    """``total`` where every row of the window around has a value, else NULL."""
    around = w.rowsBetween(-reach, reach)
    return F.when(F.count("value").over(around) == F.count(F.lit(1)).over(around), total)


def _window(keys: Keys, bounded: bool):
    return Window.partitionBy(*keys, *([] if bounded else ["_block"])).orderBy("idx")


def smooth_mean(df: DataFrame, keys: Keys, width: int, bounded: bool = False) -> DataFrame:
    """D1. Moving average over ``width`` samples, the ends padded with the first and last sample; NULL near a NULL."""
    m = width // 2
    w = _window(keys, bounded)
    left, right, around = w.rowsBetween(-m, 0), w.rowsBetween(0, m), w.rowsBetween(-m, m)
    missing_left = (m + 1) - F.count(F.lit(1)).over(left)
    missing_right = (m + 1) - F.count(F.lit(1)).over(right)
    total = (
        F.sum("value").over(around)
        + missing_left * F.first("value").over(left)
        + missing_right * F.last("value").over(right)
    )
    return _over_neighbours(df, keys, m, bounded, _whole(w, m, total / width))


def smooth_quadratic(df: DataFrame, keys: Keys, bounded: bool = False) -> DataFrame:
    """D2. Local quadratic fit over 11 samples, the ends padded with the first and last sample; NULL near a NULL."""
    m = len(QUAD_WEIGHTS) // 2
    w = _window(keys, bounded)
    first, last = F.first("value").over(w.rowsBetween(-m, 0)), F.last("value").over(w.rowsBetween(0, m))
    total = F.lit(0.0)
    for k, weight in zip(range(-m, m + 1), QUAD_WEIGHTS):
        near = F.col("value")
        if k < 0:
            near = F.coalesce(F.lag("value", -k).over(w), first)
        elif k > 0:
            near = F.coalesce(F.lead("value", k).over(w), last)
        total = total + weight * near
    return _over_neighbours(df, keys, m, bounded, _whole(w, m, total / QUAD_SUM))
