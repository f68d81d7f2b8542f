"""Several channels of one series: alignment, choice and reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalefold.functions.numeric import finite
from scalefold.operators.indexing import TASK_ROWS, Keys, dense_index, lengths

# Fixed value: longest series kept without downsampling.
MAX_SAMPLES = 1_000_000
CHANNEL = ("series_id", "channel")


def row_mean(df: DataFrame) -> DataFrame:
    """P9. Mean over channels at each position."""
    return df.groupBy("series_id", "idx").agg(F.avg("value").alias("value"))


def align_shortest(df: DataFrame, by_row: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """P10. Drop nulls per channel, close the gaps, cut all channels to the shortest.

    Channels are re-aligned by rank, as their gaps may differ; ``by_row`` keeps
    instead the positions known in every channel.
    """
    known = df.filter(F.col("value").isNotNull())
    if by_row:
        width = df.groupBy("series_id").agg(F.count_distinct("channel").alias("_width"))
        full = (
            known.groupBy("series_id", "idx")
            .agg(F.count(F.lit(1)).alias("_have"))
            .join(width, "series_id")
            .filter(F.col("_have") == F.col("_width"))
            .select("series_id", "idx")
        )
        known = known.join(full, ["series_id", "idx"], "left_semi")
    ranked = dense_index(known, CHANNEL, ["idx"], "_rank", task_rows)
    shortest = lengths(known, CHANNEL).groupBy("series_id").agg(F.min("n").alias("_least"))
    return (
        ranked.join(shortest, "series_id")
        .filter(F.col("_rank") < F.col("_least"))
        .select(*CHANNEL, F.col("_rank").alias("idx"), "value")
    )


def flatten_arrays(df: DataFrame, keys: Keys, row: str, column: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """P13. All array elements as one series, in (row, place) order; empty arrays add nothing."""
    parts = df.select(*keys, row, F.posexplode(column).alias("_place", "value"))
    return dense_index(parts, keys, [row, "_place"], task_rows=task_rows).select(
        *keys, "idx", F.col("value").cast("double")
    )


def array_mean(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """P14. Mean of each row's array, NULL for an empty one."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.withColumn(name, F.try_divide(total, F.size(column)))


def constant_channel(df: DataFrame, constants: DataFrame, channel: int) -> DataFrame:
    """P15. Add a channel that holds one value per series at every position of channel 0."""
    filled = (
        df.filter(F.col("channel") == 0)
        .select("series_id", "idx")
        .join(constants.select("series_id", F.col("value")), "series_id")
    )
    return df.select("series_id", "channel", "idx", "value").unionByName(
        filled.select("series_id", F.lit(channel).alias("channel"), "idx", "value")
    )


def pad_align(df: DataFrame, target: DataFrame) -> DataFrame:
    """P16, P17. Every channel cut or zero-padded to ``target(series_id, length)``, in long form.

    Only the missing tail is generated; rows that exist are not joined to a grid.
    A channel counts from 0 to its last position: gaps inside it stay gaps.
    """
    have = df.groupBy(*CHANNEL).agg((F.max("idx") + 1).alias("n"))
    tail = (
        have.join(target, "series_id")
        .filter(F.col("n") < F.col("length"))
        .select(*CHANNEL, F.explode(F.sequence(F.col("n"), F.col("length") - 1)).alias("idx"), F.lit(0.0).alias("value"))
    )
    kept = df.join(target, "series_id").filter(F.col("idx") < F.col("length"))
    return kept.select(*CHANNEL, "idx", F.coalesce("value", F.lit(0.0)).alias("value")).unionByName(tail)


def downsample(df: DataFrame, keys: Keys, most: int = MAX_SAMPLES) -> DataFrame:
    """P18. ``most`` evenly spaced positions of a longer series; a shorter one stays whole.

    Each row tells by itself whether it is a chosen position, so nothing is
    joined but the series lengths.
    """
    if most < 2:
        raise ValueError("the first and the last position stay, so at least two are kept")
    step = F.col("_step")

    def place(k):
        return F.when(k == most - 1, F.col("_n") - 1).otherwise(F.floor(k * step))

    near = F.ceil(F.col("idx") / step)
    hits = F.filter(
        F.array(near - 1, near, near + 1),
        lambda k: k.between(0, most - 1) & (place(k) == F.col("idx")),
    )
    long = F.col("_n") > most
    sized = df.join(lengths(df, keys, "_n"), list(keys)).withColumn("_step", (F.col("_n") - 1) / F.lit(float(most - 1)))
    return sized.withColumn("idx", F.explode(F.when(long, hits).otherwise(F.array("idx")))).drop("_n", "_step")


def head(df: DataFrame, most: int | None = None) -> DataFrame:
    """P19. The first ``most`` samples of each series; all of them by default."""
    return df if most is None else df.filter(F.col("idx") < most)


def valid_channels(df: DataFrame, least: int = 1024) -> DataFrame:
    """P20. Channels with at least ``least`` rows and any finite value, with their lengths."""
    return (
        df.groupBy("series_id", "channel")
        .agg(F.count(F.lit(1)).alias("n"), F.count(finite(F.col("value"))).alias("_known"))
        .filter((F.col("n") >= least) & (F.col("_known") > 0))
        .select("series_id", "channel", "n")
    )


def longest_channel(channel_lengths: DataFrame) -> DataFrame:
    """P21. The longest channel per series; of equally long ones the highest."""
    w = Window.partitionBy("series_id").orderBy(F.desc("n"), F.desc("channel"))
    return channel_lengths.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def other_channels(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """P22. All channels but the chosen one."""
    return df.join(chosen.select(*CHANNEL), list(CHANNEL), "left_anti")
