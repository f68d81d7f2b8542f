"""Denoising by family (D0) and the choice of measurement channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.operators import channels as ch
from scalefold.operators import cleaning as cl
from scalefold.operators.indexing import Keys, lengths
from scalefold.operators.power import normalised_bins, welch
from scalefold.operators.smoothing import smooth_mean, smooth_quadratic
from scalefold.operators.wavelet import shrink

# Smoothing widths and wavelet levels of the recipes.
STRAIN_WIDTH = 7
LINES_LEVEL, LINES_WIDTH = 4, 5
PULSAR_LEVEL = 5

RECIPES = {
    "strain": lambda df, keys, b: smooth_mean(cl.scale_by(df), keys, STRAIN_WIDTH, b),
    "lines": lambda df, keys, b: smooth_mean(shrink(cl.log_magnitude(df), keys, LINES_LEVEL, b), keys, LINES_WIDTH, b),
    "pulsar": lambda df, keys, b: smooth_quadratic(shrink(df, keys, PULSAR_LEVEL, b), keys, b),
    "z_score": lambda df, keys, b: cl.standardise(df, keys, b),
    "unit_std": lambda df, keys, b: cl.unit_std(df, keys, b),
}


def denoise(df: DataFrame, keys: Keys, recipes: dict[str, str], bounded: bool = False) -> DataFrame:
    """D0. Each family (column ``family``) by its recipe; ``recipes`` maps family to recipe name.

    One branch per recipe in use. The family filter reaches the scan, so the
    branches together read the samples once.
    """
    by = [*keys, "family"]
    parts = []
    for recipe in dict.fromkeys(recipes.values()):
        families = [f for f, r in recipes.items() if r == recipe]
        part = df.filter(F.col("family").isin(families)).select(*by, "idx", "value")
        parts.append(RECIPES[recipe](part, by, bounded).select(*by, "idx", "value"))
    return reduce(DataFrame.unionByName, parts)


# Families measured by their power spectrum, and least values of a side channel.
POWER_FAMILIES = ("strain", "sky_map", "sky_map_survey", "bits")
SIDE_LEAST = 10


def measurement_channels(samples: DataFrame, recipes: dict[str, str], least: int = 1024) -> DataFrame:
    """D9. Rows ``(series_id, col, idx, value)`` of the measurement matrix, with their ``kind``.

    ``samples(series_id, family, channel, idx, value)``. Series with further
    valid channels give those, denoised and aligned with the chosen one; power
    families and single-channel series give normalised power bins; so do pulsars
    too short for any valid channel, from their residuals as they are.
    """
    valid = ch.valid_channels(samples, least)
    chosen = ch.longest_channel(valid).join(samples.select("series_id", "family").distinct(), "series_id")
    others = valid.join(chosen.select("series_id", "channel"), ["series_id", "channel"], "left_anti")
    # side channels of pulsars need only a few values; everything else was checked above
    pulsar_sides = (
        lengths(samples.filter((F.col("family") == "pulsar") & (F.col("channel") > 0)), ch.CHANNEL)
        .filter(F.col("n") > SIDE_LEAST)
    )
    pulsars = samples.filter(F.col("family") == "pulsar").select("series_id").distinct()
    sides = (
        others.join(pulsars, "series_id", "left_anti")
        .unionByName(pulsar_sides)
        .join(samples.filter(F.col("family").isin(*POWER_FAMILIES)).select("series_id").distinct(), "series_id", "left_anti")
    )
    side_rows = samples.join(sides.select(*ch.CHANNEL), list(ch.CHANNEL), "left_semi")
    target = chosen.select("series_id", F.col("n").alias("length"))
    missing = sides.join(chosen, "series_id", "left_anti").groupBy("series_id").agg(F.max("n").alias("length"))
    clean = denoise(side_rows, ch.CHANNEL, recipes)
    aligned = ch.pad_align(clean.select(*ch.CHANNEL, "idx", "value"), target.unionByName(missing))
    by_power = chosen.join(sides.select("series_id").distinct(), "series_id", "left_anti")
    main = denoise(samples.join(by_power.select(*ch.CHANNEL), list(ch.CHANNEL), "left_semi"), ch.CHANNEL, recipes)
    # a pulsar too short for a valid channel and without sides: power of its residuals as they are
    short = (
        pulsars.join(chosen.select("series_id"), "series_id", "left_anti")
        .join(sides.select("series_id").distinct(), "series_id", "left_anti")
    )
    raw = samples.filter(F.col("channel") == 0).join(short, "series_id", "left_semi")
    main = main.select("series_id", "idx", "value").unionByName(raw.select("series_id", "idx", "value"))
    bins = normalised_bins(welch(main, ("series_id",)), main, ("series_id",))
    return aligned.select("series_id", F.col("channel").alias("col"), "idx", "value", F.lit("channel").alias("kind")).unionByName(
        bins.select(
            "series_id",
            F.col("bin").alias("col"),
            F.col("repeat").cast("bigint").alias("idx"),
            "value",
            F.lit("power").alias("kind"),
        )
    )
