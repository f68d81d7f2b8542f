"""The three entry points: subset measurement, indices, and the whole run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.config import DISC_RADIUS, FAMILIES, Family, family_config
from scalefold.operators import channels as ch
from scalefold.operators import coherence as co
from scalefold.operators import export as ex
from scalefold.operators import packed as pk
from scalefold.operators import sampling as sa
from scalefold.operators import summary as su
from scalefold.operators.arrays import MIN_SEGMENTS
from scalefold.operators.denoise import denoise, measurement_channels
from scalefold.operators.grids import LINES_MAX, lines_grid
from scalefold.operators.indexing import lengths

SUBSET = ("series_id", "subset_id")


def recipes(families: list[Family]) -> dict[str, str]:
    return {f.name: f.denoise for f in families}


def series_lengths(samples: DataFrame) -> DataFrame:
    """Length per series; ``samples`` carry ``family``."""
    return lengths(samples, ["series_id", "family"])


def subset_grids(plan: DataFrame, families: list[Family]) -> DataFrame:
    """Scales per series: the family's fixed list, or the grid for the whole length of the series (M1)."""
    spark = plan.sparkSession
    fixed = family_config(spark, families).select("family", F.col("scales").alias("_fixed"))
    top = F.expr(f"cast(least(n div 4, {LINES_MAX}) as int)")
    return (
        plan.withColumn("top", top)
        .join(F.broadcast(fixed), "family")  # one row per family
        .join(F.broadcast(lines_grid(spark)), "top", "left")  # at most 500 rows
        .withColumn("_all", F.when(F.size("_fixed") > 0, F.col("_fixed")).otherwise(F.col("scales")))
        # a scale without two segments in a subset has no F: it need not multiply the rows
        .select("series_id", F.filter("_all", lambda s: MIN_SEGMENTS * s <= F.col("size")).alias("scales"))
    )


def subset_rows(
    samples: DataFrame, windows: DataFrame, families: list[Family], points: DataFrame | None = None, seed: int = sa.SEED
) -> DataFrame:
    """R2, R5. Denoised rows of every subset (K12): windows of a series, random discs of a map.

    ``samples(series_id, idx, value)``; windows carry ``family``. ``points(series_id,
    family, idx, pixel, value, x, y, z)`` are the maps of the families in DISC_RADIUS,
    whose subsets come from there.
    """
    mapped = {f.name: DISC_RADIUS[f.name] for f in families if f.name in DISC_RADIUS and points is not None}
    cut = sa.subset_samples(samples, windows.filter(~F.col("family").isin(*mapped)) if mapped else windows)
    for family in (f for f in families if f.name in mapped):
        own = points.filter(F.col("family") == family.name)
        planned = windows.filter(F.col("family") == family.name)
        discs = sa.disc_subset(own, family.n_subsets, mapped[family.name], family.subset_size, family.min_std, seed)
        discs = discs.select(*SUBSET, F.col("pick").cast("bigint").alias("idx"), "value")
        cut = cut.unionByName(
            discs.join(planned.select("family", *SUBSET, "size"), list(SUBSET)).select(cut.columns)
        )
    # from here on a subset is a group: placed by it, one hot series is spread over as many tasks as it has subsets
    cut = cut.repartition(*SUBSET)
    return denoise(cut, (*SUBSET, "size"), recipes(families), bounded=True)  # size goes with the subset


def fixed_scales(families: list[Family]) -> list[int] | None:
    """The scales all families share; None if some go by the length of the series."""
    grids = {tuple(f.scales) for f in families}
    return list(grids.pop()) if len(grids) == 1 and all(grids) else None


def window_scales(windows: DataFrame, plan: DataFrame, families: list[Family]) -> DataFrame:
    """Windows with their scales (M1) and the recipe to denoise them by."""
    scales = fixed_scales(families)
    if scales is not None:
        own = windows.withColumn("scales", F.lit(scales).cast("array<int>"))
    else:
        own = windows.join(subset_grids(plan, families), "series_id")
    recipe = F.create_map(*[F.lit(x) for f in families for x in (f.name, f.denoise)])
    return own.withColumn("recipe", recipe[F.col("family")])


def _by_recipe(
    samples: DataFrame, windows: DataFrame, plan: DataFrame, families: list[Family], points: DataFrame | None, seed: int,
    cut: Callable[[DataFrame, DataFrame, int], DataFrame], rows: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """``cut(samples, windows, longest)`` of families whose recipe works on arrays, ``rows(denoised rows, windows)`` of the others and of discs of maps."""
    own = window_scales(windows, plan, families)
    mapped = [f.name for f in families if f.name in DISC_RADIUS and points is not None]
    direct = [f for f in families if f.denoise in pk.RECIPES and f.name not in mapped]
    parts = []
    if direct:
        names = [f.name for f in direct]
        longest = max(f.subset_size for f in direct)
        longest = max(longest, sa.SHORT_SIZE[1])  # what the plan gives a short series
        chosen = samples if len(direct) == len(families) else samples.filter(F.col("family").isin(names))
        parts.append(cut(chosen, own.filter(F.col("family").isin(names)), longest))
    rest = [f for f in families if f not in direct]
    if rest:
        names = [f.name for f in rest]
        few = windows.filter(F.col("family").isin(names))
        clean = subset_rows(samples.filter(F.col("family").isin(names)), few, rest, points, seed)
        parts.append(rows(clean, own.filter(F.col("family").isin(names))))
    return reduce(DataFrame.unionByName, parts)


def measure_subsets(
    samples: DataFrame, windows: DataFrame, plan: DataFrame, families: list[Family], points: DataFrame | None = None,
    columns: Sequence[str] = pk.WHOLE,
) -> DataFrame:
    """M15. Extract, denoise and measure every subset of every series, one row per subset that has an F.

    Families whose recipe works on arrays are cut and denoised in the step that measures; the
    others, and discs of maps, come as denoised rows. ``columns`` are those that leave the step.
    """
    return _by_recipe(
        samples, windows, plan, families, points, sa.SEED,
        lambda s, w, longest: pk.measure_windows(s, w, longest, columns=columns), lambda r, w: pk.measure_rows(r, w, columns=columns),
    )


def pack_subsets(
    samples: DataFrame, windows: DataFrame, plan: DataFrame, families: list[Family], points: DataFrame | None = None, seed: int = sa.SEED
) -> DataFrame:
    """K12. Every subset cut and denoised, one row a window."""
    return _by_recipe(samples, windows, plan, families, points, seed, pk.pack_windows, pk.pack_rows)


def subset_spectra(
    samples: DataFrame, windows: DataFrame, plan: DataFrame, families: list[Family], points: DataFrame | None = None
) -> DataFrame:
    """Spectra of all subsets, one row per q."""
    return pk.spectrum_rows(measure_subsets(samples, windows, plan, families, points))


def index_series(samples: DataFrame, families: list[Family], most: int = ch.MAX_SAMPLES, least: int = 1) -> DataFrame:
    """P20, P21, P18. The series an index is made from: the longest valid channel, denoised, evenly thinned to ``most``.

    ``samples(series_id, family, [channel], idx, value)``; a channel is valid with ``least`` rows and any finite value.
    """
    if "channel" in samples.columns:
        chosen = ch.longest_channel(ch.valid_channels(samples, least)).select("series_id", "channel")
        samples = samples.join(chosen, ["series_id", "channel"], "left_semi").drop("channel")
    return ch.downsample(denoise(samples, ("series_id",), recipes(families)), ("series_id",), most)


def subset_results(measures: DataFrame, windows: DataFrame) -> DataFrame:
    """M13. One row per planned subset; NULL where it could not be measured."""
    own = measures.select(*SUBSET, "d_f", "mean_h", "n_valid_q", "n_scales_used")
    return windows.join(own, list(SUBSET), "left")


def run_label() -> str:
    """Names a run by the time it started, in UTC."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")


@dataclass
class Run:
    """Tables of one run, read back from where they were written."""

    plan: DataFrame
    windows: DataFrame
    spectra: DataFrame
    results: DataFrame
    summary: DataFrame
    health: DataFrame
    pairs: DataFrame
    indices: DataFrame


def index_spectra(
    whole: DataFrame, subset_spec: DataFrame, windows: DataFrame, seed: int = sa.SEED
) -> tuple[DataFrame, DataFrame]:
    """Packed spectra behind TCI and MCI, keyed by fold; the full run is fold -1.

    ``whole`` holds the spectra of whole series, ``subset_spec`` those of
    subsets. Folds are drawn from all planned ``windows`` of a series with any
    spectrum, measured or not, and are a key column, so all of them are one query.
    """
    subsets = windows.select(*SUBSET).join(subset_spec.select("series_id").distinct(), "series_id", "left_semi")
    members = sa.folds(subsets, seed)
    keyed = members.unionByName(subsets.select(F.lit(-1).alias("fold"), *SUBSET)).join(subset_spec, list(SUBSET))
    tci_spec = co.interpolate(whole)
    tci_all = tci_spec.withColumn("fold", F.lit(-1)).unionByName(
        sa.present_in_fold(members, tci_spec).select("series_id", "q_pos", "q", "h", "fold")
    )
    return co.pack(tci_all, "fold"), co.pack(co.mean_spectra(keyed, ("fold", "series_id")), "fold")


def compute_indices(tci_packed: DataFrame, mci_packed: DataFrame, legacy_zero: bool = False) -> DataFrame:
    """Entry 3. TCI and MCI of the full run and of every fold."""
    tci = co.mean_coherence(tci_packed, "tci", legacy_zero=legacy_zero)
    return co.assemble_base(tci, co.mean_coherence(mci_packed, "mci"))


def compute_pairs(tci_packed: DataFrame, mci_packed: DataFrame) -> DataFrame:
    """Pair rows of the full run."""
    return co.pair_correlations(tci_packed.filter("fold = -1"), "TCI").unionByName(
        co.pair_correlations(mci_packed.filter("fold = -1"), "MCI")
    )


def run(
    spark: SparkSession,
    samples: DataFrame,
    out: str,
    families: list[Family] = FAMILIES,
    tci_samples: DataFrame | None = None,
    run_id: str | None = None,
    seed: int = sa.SEED,
    head: int | None = None,
    points: DataFrame | None = None,
    catalog: DataFrame | None = None,
) -> Run:
    """Entry 1. Measure all series and write every table below ``out/run_id``.

    ``samples(series_id, family, [channel], idx, value)``: subsets are cut from channel 0,
    indices are made from the longest channel. ``points`` are maps for disc subsets,
    ``catalog`` names the series that were asked for. Each table is written once and
    later steps read it back, so no step repeats the work of another. Without a
    ``run_id`` the run is named by the clock.
    """
    base = f"{out.rstrip('/')}/{run_id or run_label()}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    config = family_config(spark, families)
    kept(config, "config")
    first = samples.filter("channel = 0").drop("channel") if "channel" in samples.columns else samples
    sizes = kept(series_lengths(first), "lengths")
    plan = kept(sa.subset_plan(sizes, config), "plan")
    windows = kept(sa.subset_windows(plan, seed), "windows")
    clean = subset_rows(first, windows, families, points, seed)
    packed = kept(pk.pack_rows(clean, window_scales(windows, plan, families)), "denoised_subsets")
    measures = kept(pk.measure_packed(packed), "fluctuations")
    spectra = kept(pk.spectrum_rows(measures), "spectra")
    results = kept(subset_results(measures, windows), "results")
    summary = kept(su.dataset_summary(results, config), "summary")
    profile = kept(su.spectrum_profile(spectra), "profile")
    errors = kept(ex.errors(results, sizes), "errors")
    kept(ex.subset_warnings(results), "warnings")
    health = kept(su.health(summary, su.spectrum_width(profile), plan, errors), "health")

    least = F.coalesce(F.col("tci_min_len"), F.lit(0))
    if tci_samples is None:
        tci_samples = index_series(samples, families)
    # only series with a measured subset take part
    measured = results.filter(F.col("d_f").isNotNull()).select("series_id").distinct()
    long_enough = sizes.join(config.select("family", "tci_min_len"), "family").filter(F.col("n") >= least)
    long_enough = long_enough.select("series_id").join(measured, "series_id", "left_semi")
    tci_samples = kept(tci_samples.join(long_enough, "series_id", "left_semi"), "tci_samples")
    channels = samples if "channel" in samples.columns else samples.withColumn("channel", F.lit(0))
    matrix = kept(measurement_channels(channels, recipes(families)), "measurements")
    catalog = samples.select("series_id").distinct() if catalog is None else catalog.select("series_id")
    kept(ex.load_meta(channels, catalog, plan.select("series_id", "n_subsets"), tci_samples, matrix), "load_meta")
    whole = kept(co.whole_spectra(tci_samples, head), "whole_spectra")
    tci_packed, mci_packed = index_spectra(whole, spectra, windows, seed)
    tci_packed, mci_packed = kept(tci_packed, "tci_spectra"), kept(mci_packed, "mci_spectra")
    pairs = kept(compute_pairs(tci_packed, mci_packed), "pairs")
    kept(ex.index_diagnostics(whole, co.defined_pairs(tci_packed.filter("fold = -1"))), "index_diagnostics")
    raw = kept(compute_indices(tci_packed, mci_packed), "indices_raw")
    indices = kept(co.assemble(raw), "indices")
    spread = co.fold_spread(indices)
    ex.write_csv(ex.flat_results(pairs, results, indices, spread), f"{base}/flat_csv")
    draws = co.blend(co.bootstrap_draws(indices.select("fold", "tci", "mci")))
    ex.write_json(ex.index_document(indices, draws, spread), f"{base}/index_json")
    ex.write_json(ex.dataset_documents(summary, health, results, profile, spectra), f"{base}/dataset_json")
    ex.write_json(ex.snapshot(tci_samples, ex.SNAPSHOT), f"{base}/snapshot_json")
    ex.write_json(ex.manifest(config), f"{base}/manifest_json")
    return Run(plan, windows, spectra, results, summary, health, pairs, indices)
