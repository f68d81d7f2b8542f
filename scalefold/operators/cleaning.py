"""Row-level cleaning of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.functions.numeric import finite
from scalefold.operators.indexing import TASK_ROWS, Keys, group_stats, quantiles

# Fixed values.
MIN_VALUES = 10
TRIM = (0.025, 0.975)
CLIP = (0.01, 0.99)
LOW_STD = 1e-5
Z_FLOOR = 1e-10
STRAIN_GAIN = 1e16


def drop_null_columns(df: DataFrame) -> DataFrame:
    """P2. One counting pass over all columns; one row reaches the driver."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def min_count_gate(df: DataFrame, keys: Keys, least: int = MIN_VALUES) -> DataFrame:
    """P3, P20, P24. Keep groups with at least ``least`` known values.

    Counted with map-side combine and joined back: a window would gather a
    long series in one task.
    """
    kept = df.groupBy(*keys).agg(F.count("value").alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return df.join(kept, list(keys), "left_semi")


def quantile_trim(df: DataFrame, keys: Keys, probs: Sequence[float] = TRIM, task_rows: int = TASK_ROWS) -> DataFrame:
    """P4. Keep values between two quantiles, both ends included."""
    q = quantiles(df, keys, probs, task_rows=task_rows)
    return df.join(q, list(keys)).filter(F.col("value").between(F.col("p0"), F.col("p1"))).drop("p0", "p1")


def winsorize(df: DataFrame, keys: Keys, probs: Sequence[float] = CLIP, task_rows: int = TASK_ROWS) -> DataFrame:
    """P5. Clip values to two quantiles."""
    q = quantiles(df, keys, probs, task_rows=task_rows)
    clipped = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", "p0"), F.col("p1")))
    return df.join(q, list(keys), "left").withColumn("value", clipped).drop("p0", "p1")


def median_impute(df: DataFrame, keys: Keys, task_rows: int = TASK_ROWS) -> DataFrame:
    """P6, P7. NaN and infinities become the median of the finite values; rows without one are dropped."""
    clean = df.withColumn("value", finite(F.col("value")))
    mid = quantiles(clean, keys, [0.5], task_rows=task_rows)
    return (
        clean.join(mid, list(keys), "left")
        .withColumn("value", F.coalesce("value", "p0"))
        .filter(F.col("value").isNotNull())
        .drop("p0")
    )


def to_radians(df: DataFrame, channels: Sequence[int]) -> DataFrame:
    """P8. Degrees to radians on some channels."""
    hit = F.col("channel").isin(list(channels))
    return df.withColumn("value", F.when(hit, F.radians("value")).otherwise(F.col("value")))


def members(df: DataFrame, column: str, allowed: Sequence | DataFrame) -> DataFrame:
    """P11. Keep rows whose ``column`` is in a short list, or in a table's column of that name."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(allowed)))


def lookup(df: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """P12. Name for a code, the code itself where the table has none."""
    return df.join(names.select(code, name), code, "left").withColumn(
        name, F.coalesce(F.col(name).cast("string"), F.col(code).cast("string"))
    )


def register_series(lengths: DataFrame, thresholds: dict[str, int], other: int = 0) -> DataFrame:
    """P23. Series long enough for their family's threshold (columns ``family`` and ``n``)."""
    least = F.lit(other)
    for family, n in thresholds.items():
        least = F.when(F.col("family") == family, F.lit(n)).otherwise(least)
    return lengths.filter(F.col("n") >= least)


def scale_by(df: DataFrame, gain: float = STRAIN_GAIN) -> DataFrame:
    return df.withColumn("value", F.col("value") * gain)


def log_magnitude(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.log1p(F.abs("value")))


def standardise(df: DataFrame, keys: Keys, bounded: bool = False) -> DataFrame:
    """P25. (x - mean) / (std + 1e-10)."""
    stats = group_stats(df, keys, bounded, _mean=F.avg("value"), _std=F.stddev_pop("value"))
    return stats.withColumn("value", (F.col("value") - F.col("_mean")) / (F.col("_std") + Z_FLOOR)).drop(
        "_mean", "_std"
    )


def unit_std(df: DataFrame, keys: Keys, bounded: bool = False) -> DataFrame:
    """P25. x / std; NULL for a constant series."""
    stats = group_stats(df, keys, bounded, _std=F.stddev_pop("value"))
    return stats.withColumn("value", F.try_divide("value", "_std")).drop("_std")


def low_variability(df: DataFrame, keys: Keys, least: float = LOW_STD) -> DataFrame:
    """P26. One row per group: its spread, and whether it is below the limit."""
    return (
        df.groupBy(*keys)
        .agg(F.stddev_pop("value").alias("std"))
        .withColumn("low_variability", F.coalesce(F.col("std") < least, F.lit(True)))
    )
