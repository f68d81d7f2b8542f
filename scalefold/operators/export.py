"""Result tables, documents and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalefold.operators.indexing import lengths

# The columns of the flat table, its row cap, the snapshot length.
FLAT_COLUMNS = {
    "type": "string", "pair": "string", "dataset": "string", "subset_idx": "int", "D_f": "double", "hq_mean": "double",
    "corr": "double", "wavelet_corr": "double", "weight": "double", "tci_global": "double", "mci_global": "double",
    "fold_idx": "int", "tmci_value": "double", "tmci_global": "double", "tmci_std_cv": "double",
}
ROW_CAP = 5_000
SNAPSHOT = 32_758


def _flat(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    return df.select(
        *[
            (F.lit(kind) if c == "type" else columns.get(c, F.lit(None))).cast(t).alias(c)
            for c, t in FLAT_COLUMNS.items()
        ]
    )


def first_subsets(results: DataFrame, cap: int | None = None) -> DataFrame:
    """K2. All subset rows, or the first ``cap`` in dataset then subset order: a top-k report."""
    return results if cap is None else results.orderBy("series_id", "subset_id").limit(cap)


def flat_results(
    pairs: DataFrame, results: DataFrame, indices: DataFrame, spread: DataFrame, cap: int | None = None
) -> DataFrame:
    """K1, U1. Pair, fold, subset and global rows under one set of columns.

    ``cap`` (ROW_CAP in the published table) keeps the first subset rows only.
    """
    pair = F.concat_ws("|", "ds_a", "ds_b")
    parts = [
        _flat(pairs.filter(F.col("index") == i), i, pair=pair, corr=F.col("abs_corr")) for i in ("TCI", "MCI")
    ]
    parts.append(
        _flat(indices.filter("fold >= 0"), "TMCI_fold", fold_idx=F.col("fold"), tmci_value=F.col("tmci"))
    )
    parts.append(
        _flat(
            first_subsets(results, cap),
            "MFDFA_subset",
            dataset=F.col("series_id"),
            subset_idx=F.col("subset_id"),
            D_f=F.col("d_f"),
            hq_mean=F.col("mean_h"),
        )
    )
    parts.append(
        _flat(
            indices.filter("fold = -1").crossJoin(spread),  # one row each
            "GLOBAL",
            tci_global=F.col("tci"),
            mci_global=F.col("mci"),
            tmci_global=F.col("tmci"),
            tmci_std_cv=F.col("tmci_std_cv"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """K3. CSV with a header; ``single`` makes one file of a table known to be small."""
    (df.coalesce(1) if single else df).write.option("header", True).csv(path)


def snapshot(samples: DataFrame, max_len: int) -> DataFrame:
    """K7. The first ``max_len`` samples of each series as one array, with full and used length.

    Cutting is the feature: an array has to fit a row (SNAPSHOT in the published file).
    """
    size = lengths(samples, ["series_id"], "length_full")
    heads = (
        samples.filter(F.col("idx") < max_len)
        .groupBy("series_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    )
    return heads.join(size, "series_id").select(
        "series_id",
        "length_full",
        F.size("_s").cast("bigint").alias("length_used"),
        (F.col("length_full") > max_len).alias("truncated"),
        F.transform("_s", lambda s: s["value"]).alias("data"),
    )


def manifest(config: DataFrame, name: str = "definition") -> DataFrame:
    """K8. JSON text of each definition row and its SHA-256."""
    return config.select(*config.columns, F.to_json(F.struct(*config.columns)).alias(name)).withColumn(
        "sha256", F.sha2(name, 256)
    )


def load_meta(
    samples: DataFrame,
    catalog: DataFrame,
    subsets: DataFrame,
    index_samples: DataFrame | None = None,
    matrix: DataFrame | None = None,
) -> DataFrame:
    """K9. Rows, subset count and status of every catalogued series; with ``index_samples`` the length of
    its index series, with the measurement ``matrix`` its shape."""
    sizes = samples.groupBy("series_id").agg(
        F.count_if(F.col("channel") == 0).alias("n_rows"),
        F.count_distinct("channel").alias("n_channels"),
        F.count("value").alias("n_values"),
    )
    known = catalog.select("series_id").join(sizes, "series_id", "left").join(subsets, "series_id", "left")
    if index_samples is not None:
        known = known.join(lengths(index_samples, ["series_id"], "tci_length"), "series_id", "left")
    if matrix is not None:
        # a channel has a row per position; a row of power bins is repeated ``idx`` times
        rows = F.max(F.when(F.col("kind") == "channel", F.col("idx") + 1).otherwise(F.col("idx")))
        shape = matrix.groupBy("series_id").agg(rows.alias("matrix_rows"), F.count_distinct("col").alias("matrix_columns"))
        known = known.join(shape, "series_id", "left")
    return (
        known
        .withColumn("status", F.when(F.col("n_rows") >= 10, "OK").otherwise("SKIPPED"))
    )


def errors(results: DataFrame, series_lengths: DataFrame, least: int = 10) -> DataFrame:
    """K10. One row per series that could not be measured, with the reason."""
    too_short = series_lengths.filter(F.col("n") < least).select("series_id", F.lit("No or insufficient data").alias("error"))
    invalid = (
        results.groupBy("series_id").agg(F.count("d_f").alias("_n")).filter("_n = 0")
        .select("series_id", F.lit("No valid D_f").alias("error"))
    )
    return too_short.unionByName(invalid)


def subset_warnings(results: DataFrame) -> DataFrame:
    """K10. Subsets without a result."""
    return results.filter(F.col("d_f").isNull()).select(
        "series_id",
        "subset_id",
        F.when(F.col("start").isNull(), "Data too short").otherwise("No valid D_f").alias("reason"),
    )


def index_diagnostics(spectra: DataFrame, in_pairs: DataFrame) -> DataFrame:
    """K13. Spectrum length and validity per dataset, with the number of defined pairs it is in.

    ``in_pairs(series_id, n_pairs)`` comes from ``coherence.defined_pairs``.
    """
    return (
        spectra.groupBy("series_id")
        .agg(F.count(F.lit(1)).alias("hq_length"), F.count("h").alias("n_valid"))
        .join(in_pairs.select("series_id", "n_pairs"), "series_id", "left")
        .withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    )


def index_document(indices: DataFrame, draws: DataFrame, spread: DataFrame) -> DataFrame:
    """K6. The nested index document; draws and folds have fixed sizes."""
    def field(name: str) -> Column:
        return F.transform("_d", lambda d: d[name]).alias(name)

    boot = (
        draws.filter("fold = -1")
        .agg(F.array_sort(F.collect_list(F.struct("draw", "tci", "mci", "tmci"))).alias("_d"))
        .select(
            F.struct(field("tci"), field("mci"), field("tmci")).alias("bootstrap")
        )
    )
    cv = indices.filter("fold >= 0").agg(F.array_sort(F.collect_list(F.struct("fold", "tmci", "ci_lo", "ci_hi"))).alias("_f"))
    cv = cv.crossJoin(spread).select(
        F.struct(
            F.transform("_f", lambda f: f["tmci"]).alias("folds"),
            F.transform("_f", lambda f: F.array(f["ci_lo"], f["ci_hi"])).alias("fold_ci"),
            F.col("tmci_std_cv").alias("std"),
        ).alias("crossval")
    )
    return (
        indices.filter("fold = -1")
        .crossJoin(boot)
        .crossJoin(cv)
        .select(
            "tci",
            "mci",
            F.struct(
                F.col("tmci").alias("mean"), F.array("ci_lo", "ci_hi").alias("ci"), "corr", "bootstrap", "crossval"
            ).alias("tmci"),
        )
    )


def dataset_documents(
    summary: DataFrame, health: DataFrame, results: DataFrame, profile: DataFrame, spectra: DataFrame | None = None
) -> DataFrame:
    """K4, K11. One nested document per dataset; its lists are as long as its plan."""
    subsets = results
    if spectra is not None:
        h = spectra.groupBy("series_id", "subset_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("q_pos", "h"))), lambda s: s["h"]).alias("hq")
        )
        subsets = results.join(h, ["series_id", "subset_id"], "left")
    cols = [c for c in ("subset_id", "d_f", "mean_h", "hq") if c in subsets.columns]
    lists = subsets.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("subsets"))
    profiles = profile.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("q_pos", "h_mean", "h_std", "h_min", "h_max"))).alias("spectrum")
    )
    stats = summary.select("series_id", F.struct(*[c for c in summary.columns if c != "series_id"]).alias("summary"))
    state = health.select("series_id", F.struct(*[c for c in health.columns if c != "series_id"]).alias("health"))
    return (
        state.join(stats, "series_id", "left").join(lists, "series_id", "left").join(profiles, "series_id", "left")
    )


def write_json(df: DataFrame, path: str) -> None:
    """K4, K5. One document per row; undefined numbers are left out as NULL."""
    df.write.json(path)
