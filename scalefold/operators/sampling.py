"""Subset policy, windows, samples without replacement and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalefold.functions.draws import draw_key, permuted, uniform
from scalefold.operators.indexing import Keys, lengths

# Fixed values of the subset policy.
SHORT_SERIES = 1250
SHORT_FRACTION = 0.10
SHORT_SIZE = (30, 125)
SHORT_SUBSETS = 75
FIXED_FAMILY = "pulsar"
MIN_SERIES = 10

FOLDS = 3
FOLD_SHARE = 0.67
FOLD_LEAST = 3

SEED = 20240101
# Positions per join block: short enough that short windows meet few foreign rows.
JOIN_BLOCK = 128


def subset_plan(series_lengths: DataFrame, config: DataFrame) -> DataFrame:
    """R1. Subset size and count per series from its length and its family's settings.

    ``series_lengths(series_id, family, n)``; ``config(family, subset_size, n_subsets)``.
    """
    n = F.col("n")
    short = (F.col("family") != FIXED_FAMILY) & (n < SHORT_SERIES)
    low, high = SHORT_SIZE
    adaptive = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(SHORT_FRACTION) * n).cast("int")))
    return (
        series_lengths.filter(n >= MIN_SERIES)
        .join(config.select("family", "subset_size", F.col("n_subsets").alias("_count")), "family")
        .select(
            "series_id",
            "family",
            n,
            F.when(short, adaptive).otherwise(F.col("subset_size")).cast("int").alias("size"),
            F.when(short, F.lit(SHORT_SUBSETS)).otherwise(F.col("_count")).cast("int").alias("n_subsets"),
            F.when(F.col("family") == FIXED_FAMILY, "fixed-family")
            .when(short, "adaptive")
            .otherwise("fixed")
            .alias("mode"),
        )
    )


def subset_windows(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """R2. One uniform start per subset; NULL where the series is shorter than the subset."""
    key = draw_key(seed, "window", "series_id", "subset_id")
    start = F.floor(uniform(key) * (F.col("n") - F.col("size") + 1))
    return (
        plan.withColumn("subset_id", F.explode(F.sequence(F.lit(0), F.col("n_subsets") - 1)))
        .withColumn("start", F.when(F.col("n") >= F.col("size"), start).cast("bigint"))
        .select("series_id", "family", "subset_id", "start", "size")
    )


def subset_samples(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """R2. Rows of every window, re-numbered from 0.

    Both sides meet on (series, block of positions): an equi join whose keys
    spread a long series, with the exact bounds as a filter.
    """
    blocks = F.sequence(F.expr(f"start div {JOIN_BLOCK}"), F.expr(f"(start + size - 1) div {JOIN_BLOCK}"))
    wide = windows.filter(F.col("start").isNotNull()).withColumn("_block", F.explode(blocks))
    rows = samples.select("series_id", "idx", "value").withColumn("_block", F.expr(f"idx div {JOIN_BLOCK}"))
    return (
        rows.join(wide, ["series_id", "_block"])
        .filter((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + F.col("size")))
        .select("series_id", "family", "subset_id", "size", (F.col("idx") - F.col("start")).alias("idx"), "value")
    )


def simple_sample(df: DataFrame, keys: Keys, k: Column | int, order: Column, tie: str) -> DataFrame:
    """R3. ``k`` rows per group without replacement, by the rank of a keyed draw.

    A constant ``k`` lets Spark cut every partition to ``k`` rows per group before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("_u", tie)
    return (
        df.withColumn("_u", order)
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= k)
        .withColumn("pick", F.col("_rank") - 1)
        .drop("_u", "_rank")
    )


def folds(subsets: DataFrame, seed: int = SEED, n_folds: int = FOLDS, share: float = FOLD_SHARE) -> DataFrame:
    """R7. For each fold a random two thirds of every series' subsets; series with too few are left out.

    ``subsets(series_id, subset_id)`` -> ``(fold, series_id, subset_id)``. A
    series has at most a few hundred subsets, so the rank is over a small group.
    """
    counts = lengths(subsets, ["series_id"], "_n").filter(F.col("_n") >= FOLD_LEAST)
    spread = subsets.join(counts, "series_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    u = uniform(draw_key(seed, "fold", "fold", "series_id", "subset_id"))
    take = F.floor(F.col("_n") * share)
    return simple_sample(spread, ["fold", "series_id"], take, u, "subset_id").select("fold", "series_id", "subset_id")


def present_in_fold(fold_series: DataFrame, spectra: DataFrame) -> DataFrame:
    """R8. Whole-series spectra, once per fold, of the series present in that fold."""
    present = fold_series.select("fold", "series_id").distinct()
    return present.join(spectra, "series_id")


# --- sky maps ---------------------------------------------------------------

# Masked colatitude band in degrees.
STRIP = (60.0, 120.0)


def strip_mask(df: DataFrame, band: tuple[float, float] = STRIP) -> DataFrame:
    """R4. Remove the band around the equator; pixel ids stay as they are."""
    lo, hi = (math.radians(b) for b in band)
    return df.filter((F.col("theta") < lo) | (F.col("theta") > hi))


def disc_members(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """R5, J4. Points within ``radius`` (radians) of each centre.

    Unit vectors fall into cubes as wide as the disc's chord, so a disc only
    meets the 27 cubes around its centre: an equi join, then the exact test.
    """
    width = 2.0 * math.sin(min(radius, math.pi) / 2.0) + 1e-9
    cube = {c: F.floor(F.col(c) / width).cast("int") for c in ("x", "y", "z")}
    left = points.select(
        "series_id", "pixel", "value", "x", "y", "z", cube["x"].alias("_i"), cube["y"].alias("_j"), cube["z"].alias("_k")
    )
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = centres.select(
        "series_id", "subset_id", "x", "y", "z", cube["x"].alias("_i"), cube["y"].alias("_j"), cube["z"].alias("_k")
    )
    for c in ("_i", "_j", "_k"):
        right = right.withColumn("_d", F.explode(offsets)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    right = right.withColumnsRenamed({"x": "cx", "y": "cy", "z": "cz"})
    dot = F.col("x") * F.col("cx") + F.col("y") * F.col("cy") + F.col("z") * F.col("cz")
    return (
        left.join(right, ["series_id", "_i", "_j", "_k"])
        .filter(dot >= math.cos(radius))
        .select("series_id", "subset_id", "pixel", "value")
    )


def disc_subset(
    points: DataFrame, n_subsets: int, radius: float, size: int, min_std: float, seed: int = SEED
) -> DataFrame:
    """R5. Random discs of exactly ``size`` points each.

    Too many points: a simple sample of them. Too few, or too little spread:
    points at random places of the whole map. ``points(series_id, idx, pixel, value, x, y, z)``
    with a dense ``idx``, from which the centres are drawn.
    """
    subsets = lengths(points, ["series_id"]).withColumn(
        "subset_id", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1)))
    )
    place = F.floor(uniform(draw_key(seed, "centre", "series_id", "subset_id")) * F.col("n"))
    centres = points.join(
        subsets.select("series_id", "subset_id", place.alias("idx")), ["series_id", "idx"]
    ).select("series_id", "subset_id", "x", "y", "z")
    sub = ["series_id", "subset_id"]
    draw = uniform(draw_key(seed, "disc", "series_id", "subset_id", "pixel"))
    inside = simple_sample(disc_members(points, centres, radius), sub, size, draw, "pixel")
    good = (
        inside.groupBy(*sub)
        .agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_std"))
        .filter((F.col("_n") == size) & (F.col("_std") >= min_std))
        .select(*sub)
    )
    poor = subsets.join(good, sub, "left_anti")
    # the places of a whole-map sample are computed, so the map meets only the rows that are taken
    picks = poor.withColumn("pick", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("n")).cast("int") - 1)))
    place = permuted(F.col("pick"), F.col("n"), seed, "anywhere", "series_id", "subset_id")
    anywhere = points.join(picks.select(*sub, "pick", place.alias("idx")), ["series_id", "idx"])
    cols = [*sub, "pick", "pixel", "value"]
    return (
        inside.join(good, sub, "left_semi")
        .select(*cols, F.lit("disc").alias("origin"))
        .unionByName(anywhere.select(*cols, F.lit("whole map").alias("origin")))
    )


# Fixed value: points per subset whose pairs are measured.
PAIR_POINTS = 50


def pair_features(points: DataFrame, keys: Keys, k: int = PAIR_POINTS, seed: int = SEED) -> DataFrame:
    """R6, J3. ln(1 + distance) of all pairs among ``k`` sampled points of each group.

    ``points(keys.., point, p0, p1, v0, v1)``. The sample bounds a group to
    k (k - 1) / 2 pairs whatever its size.
    """
    u = uniform(draw_key(seed, "pair", *keys, "point"))
    few = simple_sample(points, keys, k, u, "point").select(*keys, "pick", "p0", "p1", "v0", "v1")
    a, b = few.alias("a"), few.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    near = F.lit(0.0)
    for c in ("p0", "p1", "v0", "v1"):
        d = F.col(f"a.{c}") - F.col(f"b.{c}")
        near = near + d * d
    cond = F.col("a.pick") < F.col("b.pick")
    for s in same:
        cond = cond & s
    return a.join(b, cond).select(
        *[F.col(f"a.{c}") for c in keys],
        F.col("a.pick").alias("i"),
        F.col("b.pick").alias("j"),
        F.ln(F.sqrt(near) + 1.0).alias("value"),
    )
