"""Per-series statistics over subset results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalefold.functions.stats import two_sided_p
from scalefold.operators.sampling import SHORT_SERIES

# Fixed values.
MAD_WIDTH = 3.0
MAD_FLOOR = 1e-12
CORE_LEAST = 3
FLAT_STD = 1e-10
WARN_NULLS = 0.5
WARN_SHARE = 0.2


def mad_core(results: DataFrame) -> DataFrame:
    """A1. Mark the valid ``d_f`` near the median; if too few are, mark all valid ones."""
    # a series has as many results as its plan has subsets, at most a few hundred
    series = Window.partitionBy("series_id")
    dev = F.abs(F.col("d_f") - F.col("median_df"))
    near = F.col("_dev") <= MAD_WIDTH * (F.col("mad") + MAD_FLOOR)
    return (
        results.withColumn("median_df", F.median("d_f").over(series))
        .withColumn("_dev", dev)
        .withColumn("mad", F.median("_dev").over(series))
        .withColumn("_near", F.coalesce(near, F.lit(False)))
        .withColumn("_core", F.count_if("_near").over(series))
        .withColumn("_valid", F.count("d_f").over(series))
        .withColumn(
            "in_core",
            F.when(F.col("_core") < F.greatest(F.lit(CORE_LEAST), F.expr("_valid div 3")), F.col("d_f").isNotNull()).otherwise(
                F.col("_near")
            ),
        )
        .drop("_dev", "_near", "_core", "_valid")
    )


def dataset_summary(results: DataFrame, config: DataFrame) -> DataFrame:
    """A2-A5, A8. One row per series; ``config(family, expected_df)``, results carry ``family``."""
    core = F.when(F.col("in_core"), F.col("d_f"))
    grouped = (
        mad_core(results)
        .groupBy("series_id", "family")
        .agg(
            F.count(F.lit(1)).alias("n_subsets"),
            F.count("d_f").alias("n_valid"),
            F.avg(core).alias("mean_df"),
            F.stddev_pop(core).alias("std_df"),
            F.avg("mean_h").alias("mean_h"),
            F.avg("d_f").alias("df_mean_all"),
            F.stddev_pop("d_f").alias("df_std_all"),
            F.avg(F.col("d_f").isNull().cast("double")).alias("nan_ratio"),
        )
    )
    return z_test(grouped.join(config.select("family", "expected_df"), "family"))


def z_test(summary: DataFrame) -> DataFrame:
    """A4. z and its two-sided p from all valid ``d_f``; undefined without spread or a second value."""
    defined = (F.col("df_std_all") >= FLAT_STD) & (F.col("n_valid") >= 2)
    z = (F.col("df_mean_all") - F.col("expected_df")) / (F.col("df_std_all") / F.sqrt(F.col("n_valid").cast("double")))
    return summary.withColumn("z", F.when(defined, z)).withColumn("p_value", two_sided_p("z"))


def spectrum_profile(spectra: DataFrame) -> DataFrame:
    """A6. Mean, spread and range of h over subsets, per series and q."""
    return spectra.groupBy("series_id", "q_pos").agg(
        F.avg("h").alias("h_mean"), F.stddev_pop("h").alias("h_std"), F.min("h").alias("h_min"), F.max("h").alias("h_max")
    )


def spectrum_width(profile: DataFrame) -> DataFrame:
    """A7. Range of the mean spectrum."""
    return profile.groupBy("series_id").agg((F.max("h_mean") - F.min("h_mean")).alias("h_width"))


def health(
    summary: DataFrame, width: DataFrame, plan: DataFrame, errors: DataFrame, health_threshold: int = SHORT_SERIES
) -> DataFrame:
    """A9-A12. Status, strategy and errors of every planned series.

    ``errors(series_id, error)``. A series without any valid result has failed.
    """
    failed = errors.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_errors"), F.concat_ws("; ", F.array_sort(F.collect_set("error"))).alias("errors")
    )
    least = F.greatest(F.lit(CORE_LEAST), F.floor(F.lit(WARN_SHARE) * F.col("n_subsets")))
    short = F.col("n") < health_threshold
    joined = (
        plan.drop("family")
        .join(summary.drop("n_subsets"), "series_id", "left")
        .join(width, "series_id", "left")
        .join(failed, "series_id", "left")
        .withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
        .withColumn("nan_ratio", F.coalesce("nan_ratio", F.lit(1.0)))
        .withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    )
    return joined.select(
        "series_id",
        F.when((F.col("n_errors") > 0) | (F.col("n_valid") == 0), "FAIL")
        .when((F.col("nan_ratio") > WARN_NULLS) | (F.col("n_valid") < least), "WARN")
        .otherwise("OK")
        .alias("status"),
        F.when((F.col("n_errors") == 0) & (F.col("n_valid") == 0), "No valid D_f").otherwise(F.col("errors")).alias("reason"),
        "n",
        "n_subsets",
        "n_valid",
        "nan_ratio",
        F.col("df_mean_all").alias("df_mean"),
        F.col("df_std_all").alias("df_std"),
        "h_width",
        "p_value",
        F.when(short, "adaptive").otherwise("fixed").alias("mode"),
        F.when(short, F.format_string("n_total < %d", F.lit(health_threshold))).alias("trigger"),
        "size",
        F.try_divide(F.col("size").cast("double"), F.col("n")).alias("fraction"),
        "n_errors",
    )
