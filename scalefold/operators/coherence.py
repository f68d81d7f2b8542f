"""Coherence between series: spectra, pair correlations and indices."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalefold.functions.draws import draw_key, gaussian
from scalefold.functions.stats import pearson
from scalefold.operators import channels as ch
from scalefold.operators.fluctuation import measure
from scalefold.operators.grids import Q_GRID, whole_grid
from scalefold.operators.indexing import lengths
from scalefold.operators.sampling import SEED
from scalefold.session import land

# Fixed values.
WHOLE_LEAST = 50
Q_LEAST = 5
N_BOOT = 500
JITTER = 0.02
INTERVAL = (0.025, 0.975)

SERIES = ("series_id",)
# Series per block of the all-pairs comparison: a task holds two blocks and their pairs.
PAIR_BLOCK = 512


def whole_spectra(samples: DataFrame, head: int | None = None) -> DataFrame:
    """C0. Spectrum of every series that is long enough, on its log-spaced grid.

    ``head`` cuts every series to its first samples before that.
    """
    first = ch.head(samples.select("series_id", "idx", "value"), head)
    grids = lengths(first, SERIES).filter(F.col("n") >= WHOLE_LEAST).select("series_id", "n", whole_grid("n").alias("scales"))
    return measure(first, SERIES, grids=grids)


def interpolate(spectra: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """C2. Fill undefined h linearly between valid neighbours, ends held; series with fewer than 2 valid are dropped."""
    w = Window.partitionBy(*keys)
    back = w.orderBy("q_pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy("q_pos").rowsBetween(0, Window.unboundedFollowing)
    q_known = F.when(F.col("h").isNotNull(), F.col("q"))
    share = F.try_divide(F.col("q") - F.col("_q0"), F.col("_q1") - F.col("_q0"))
    return (
        spectra.select(*keys, "q_pos", "q", "h")
        .withColumn("_valid", F.count("h").over(w))
        .filter(F.col("_valid") >= 2)
        .withColumn("_h0", F.last("h", ignorenulls=True).over(back))
        .withColumn("_q0", F.last(q_known, ignorenulls=True).over(back))
        .withColumn("_h1", F.first("h", ignorenulls=True).over(ahead))
        .withColumn("_q1", F.first(q_known, ignorenulls=True).over(ahead))
        .select(
            *keys,
            "q_pos",
            "q",
            F.coalesce("h", F.col("_h0") + (F.col("_h1") - F.col("_h0")) * share, "_h0", "_h1").alias("h"),
        )
    )


def mean_spectra(subset_spectra: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """C4. Mean h per series and q over subsets; needs a grid of at least 5 q and any defined value."""
    means = subset_spectra.groupBy(*keys, "q_pos").agg(F.avg("h").alias("h"))
    w = Window.partitionBy(*keys)
    return (
        means.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_known", F.count("h").over(w))
        .filter((F.col("_n") >= Q_LEAST) & (F.col("_known") > 0))
        .select(*keys, "q_pos", "h")
    )


def pack(spectra: DataFrame, fold: str | None = None) -> DataFrame:
    """One row per series (and fold): h as an array over the q grid, NaN where undefined."""
    keys = ["series_id"] if fold is None else [fold, "series_id"]
    points = F.map_from_entries(F.collect_list(F.struct("q_pos", F.coalesce("h", F.lit(float("nan"))))))
    grid = F.sequence(F.lit(0), F.lit(len(Q_GRID) - 1))
    packed = spectra.groupBy(*keys).agg(points.alias("_m"))
    h = F.transform(grid, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(float("nan"))))
    return packed.select((F.lit(-1) if fold is None else F.col(fold)).alias("fold"), "series_id", h.alias("h"))


def _correlate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|r| and the number of shared points for all rows of ``a`` against all rows of ``b``."""

    def parts(x):
        known = np.isfinite(x)
        n = np.maximum(known.sum(1, keepdims=True), 1)
        x = np.where(known, x, 0.0)
        return known.astype(float), np.where(known > 0, x - x.sum(1, keepdims=True) / n, 0.0)

    (ka, xa), (kb, xb) = parts(a), parts(b)
    n = ka @ kb.T
    with np.errstate(all="ignore"):
        ma, mb = xa @ kb.T / n, ka @ xb.T / n
        va, vb = (xa * xa) @ kb.T / n - ma * ma, ka @ (xb * xb).T / n - mb * mb
        r = np.abs(xa @ xb.T / n - ma * mb) / np.sqrt(va * vb)
        r[(n < 2) | (va < 1e-24) | (vb < 1e-24)] = np.nan
    return r, n


def _block_pairs(packed: DataFrame, block: int) -> DataFrame:
    """Send every series to all pairs of its block with another, so each pair of blocks is one group.

    The spectra are written down first: their number sets the number of
    blocks, and they are read once per index.
    """
    packed = land(packed, "spectra")
    n_blocks = -(-packed.count() // block) or 1
    mine = F.pmod(F.xxhash64("series_id"), F.lit(n_blocks)).cast("int")
    return (
        packed.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .withColumn("_a", F.least("_mine", "_other"))
        .withColumn("_b", F.greatest("_mine", "_other"))
    )


def _pairs_of(pdf: pd.DataFrame):
    """Row positions of every pair a block pair is in charge of, with |r| and n."""
    pdf = pdf.sort_values("series_id", ignore_index=True)
    a, b = pdf["_a"].iat[0], pdf["_b"].iat[0]
    left = np.flatnonzero(pdf["_mine"] == a)
    right = np.flatnonzero(pdf["_mine"] == b)
    h = np.stack([np.asarray(v, dtype=float) for v in pdf["h"]])
    if len(left) == 0 or len(right) == 0:
        return pdf, left[:0], right[:0], np.empty(0), np.empty(0)
    r, n = _correlate(h[left], h[right])
    i, j = np.nonzero(np.ones_like(r, dtype=bool) if a != b else np.triu(np.ones_like(r, dtype=bool), 1))
    return pdf, left[i], right[j], r[i, j], n[i, j]


def pair_correlations(packed: DataFrame, index: str, block: int = PAIR_BLOCK) -> DataFrame:
    """C1, J1. |Pearson r| of every pair of spectra over the q both define; NULL if undefined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, i, j, r, n = _pairs_of(pdf)
        names = pdf["series_id"].to_numpy()
        first, second = np.minimum(i, j), np.maximum(i, j)  # rows are in name order
        return pd.DataFrame(
            {"fold": pdf["fold"].iat[0], "ds_a": names[first], "ds_b": names[second], "n_q": n.astype("int64"),
             "abs_corr": pd.array(r, dtype="float64")}
        )

    out = _block_pairs(packed, block).groupBy("fold", "_a", "_b").applyInPandas(
        run, "fold int, ds_a string, ds_b string, n_q bigint, abs_corr double"
    )
    return out.withColumn("index", F.lit(index)).withColumn("abs_corr", F.nanvl("abs_corr", F.lit(None).cast("double")))


def defined_pairs(packed: DataFrame, block: int = 4 * PAIR_BLOCK) -> DataFrame:
    """Number of pairs with a defined correlation each series is in, per fold, without writing the pairs out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, i, j, r, _ = _pairs_of(pdf)
        ok = np.isfinite(r)
        n = np.bincount(i[ok], minlength=len(pdf)) + np.bincount(j[ok], minlength=len(pdf))
        return pd.DataFrame({"fold": pdf["fold"], "series_id": pdf["series_id"], "n_pairs": n.astype("int64")})

    counts = _block_pairs(packed, block).groupBy("fold", "_a", "_b").applyInPandas(
        run, "fold int, series_id string, n_pairs bigint"
    )
    return counts.groupBy("fold", "series_id").agg(F.sum("n_pairs").alias("n_pairs"))


def mean_coherence(packed: DataFrame, name: str, block: int = 4 * PAIR_BLOCK, legacy_zero: bool = False) -> DataFrame:
    """C3, C5. Mean |r| over all pairs per fold, without writing the pairs out; NULL if there is none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, r, _ = _pairs_of(pdf)
        ok = np.isfinite(r)
        return pd.DataFrame({"fold": [pdf["fold"].iat[0]], "s": [float(r[ok].sum())], "n": [int(ok.sum())]})

    sums = _block_pairs(packed, block).groupBy("fold", "_a", "_b").applyInPandas(run, "fold int, s double, n bigint")
    value = F.when(F.sum("n") > 0, F.sum("s") / F.sum("n"))
    if legacy_zero:
        value = F.coalesce(value, F.lit(0.0))
    return sums.groupBy("fold").agg(value.alias(name), F.sum("n").alias(f"{name}_pairs"))


def bootstrap_draws(indices: DataFrame, n_boot: int = N_BOOT, sigma: float = JITTER, seed: int = SEED) -> DataFrame:
    """B1. Jittered copies of (tci, mci) per fold."""
    rows = indices.select("fold", "tci", "mci", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("draw"))
    return rows.select(
        "fold",
        "draw",
        (F.col("tci") + sigma * gaussian(draw_key(seed, "tci", "fold", "draw"))).alias("tci"),
        (F.col("mci") + sigma * gaussian(draw_key(seed, "mci", "fold", "draw"))).alias("mci"),
    )


def blend(draws: DataFrame) -> DataFrame:
    """B3. Weight both samples by their redundancy and blend them; a fold has a fixed number of draws."""
    corr = draws.groupBy("fold").agg(pearson(F.col("tci"), F.col("mci")).alias("corr"))
    w = (1.0 - F.abs("corr")) / 2.0
    t, m = F.col("tci"), F.col("mci")
    return draws.join(corr, "fold").withColumn("tmci", w * t + w * m + (1.0 - 2.0 * w) * ((t + m) / 2.0))


def bootstrap(draws: DataFrame) -> DataFrame:
    """B4, B5. Mean and interval of the blend; NULL where an index is undefined."""
    return (
        blend(draws)
        .groupBy("fold")
        .agg(
            F.avg("tmci").alias("tmci"),
            F.percentile("tmci", F.lit(INTERVAL[0])).alias("ci_lo"),
            F.percentile("tmci", F.lit(INTERVAL[1])).alias("ci_hi"),
            F.first("corr", ignorenulls=True).alias("corr"),
        )
    )


def assemble(indices: DataFrame) -> DataFrame:
    """B6, B7. All folds with their bootstrap; the full run is fold -1."""
    return indices.join(bootstrap(bootstrap_draws(indices)), "fold")


def fold_spread(assembled: DataFrame) -> DataFrame:
    """B6. Spread of the fold means."""
    return assembled.filter(F.col("fold") >= 0).agg(
        F.stddev_pop("tmci").alias("tmci_std_cv"), F.count("tmci").alias("n_folds")
    )


def assemble_base(tci: DataFrame, mci: DataFrame) -> DataFrame:
    """B7. TCI and MCI side by side, one row per fold; NULL where one of them has no pair."""
    return tci.join(mci, "fold", "full").select("fold", "tci", "mci", "tci_pairs", "mci_pairs")
