"""Averaged periodograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalefold.operators.indexing import Keys, lengths

# Longest frame, bins kept, floor of the normalisation.
MAX_FRAME = 1024
KEPT_BINS = 8
PEAK_FLOOR = 1e-10


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _frame_power(x: pd.Series) -> pd.Series:
    """One-sided power of a mean-free, Hann-weighted frame, per unit sampling rate."""

    def one(values) -> np.ndarray:
        values = np.asarray(values, dtype=float)
        n = len(values)
        w = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((values - values.mean()) * w)) ** 2 / (w * w).sum()
        p[1 : len(p) - (1 - n % 2)] *= 2.0
        return p

    return x.map(one)


def welch(df: DataFrame, keys: Keys, fs: float = 1.0, max_frame: int = MAX_FRAME) -> DataFrame:
    """D7. Mean power of half-overlapping frames of min(1024, n div 4) samples, one row per bin.

    A sample belongs to at most three frames and a frame holds at most
    ``max_frame`` samples, so a long series is spread over its frames.
    """
    size = lengths(df, keys, "_n").select(
        *keys, F.least(F.lit(max_frame), F.expr("cast(_n div 4 as int)")).alias("nps"), "_n"
    )
    hop = F.col("nps") - F.expr("nps div 2")
    last = F.floor((F.col("_n") - F.col("nps")) / hop)
    from_frame = F.greatest(F.lit(0), F.floor((F.col("idx") - F.col("nps")) / hop) + 1)
    to_frame = F.least(last, F.floor(F.col("idx") / hop))
    frames = (
        df.join(size.filter(F.col("nps") > 0), list(keys))
        .withColumn("_from", from_frame)
        .withColumn("_to", to_frame)
        .filter(F.col("_from") <= F.col("_to"))
        .select(*keys, "nps", "idx", "value", F.explode(F.sequence("_from", "_to")).alias("frame"))
        .groupBy(*keys, "nps", "frame")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("x"))
    )
    return (
        frames.select(*keys, "nps", _frame_power("x").alias("_p"))
        .select(*keys, "nps", F.posexplode("_p").alias("bin", "p"))
        .groupBy(*keys, "nps", "bin")
        .agg((F.avg("p") / fs).alias("power"), F.count(F.lit(1)).alias("n_frames"))
    )


def normalised_bins(psd: DataFrame, samples: DataFrame, keys: Keys, bins: int = KEPT_BINS) -> DataFrame:
    """D8. Power over its maximum, first bins only, with the number of times the row is repeated.

    A spectrum has at most 513 bins.
    """
    peak = psd.groupBy(*keys).agg(F.max("power").alias("_peak"), F.count(F.lit(1)).alias("_bins"))
    return (
        psd.filter(F.col("bin") < bins)
        .join(peak, list(keys))
        .join(lengths(samples, keys, "_n"), list(keys))
        .select(
            *keys,
            "bin",
            (F.col("power") / (F.col("_peak") + PEAK_FLOOR)).alias("value"),
            (F.expr("_n div _bins") + 1).alias("repeat"),
        )
    )


def repeat_rows(bins: DataFrame, keys: Keys) -> DataFrame:
    """The repeated matrix in long form, for callers that want every row."""
    return bins.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repeat") - 1)).alias("row"), F.col("bin").alias("col"), "value"
    )
