"""Dense positions, exact quantiles and block splitting for series of any length.

One series may hold a large share of all rows. A window partitioned by the
series would then sort that share in one task, so every operator here checks
the size of the largest group first and changes to a range-partitioned plan
above ``TASK_ROWS``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalefold.session import land

# Rows of one group that a single task may sort.
TASK_ROWS = 1_000_000

Keys = Sequence[str]


def lengths(df: DataFrame, keys: Keys, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def largest_group(df: DataFrame, keys: Keys) -> int:
    """Rows of the largest group: one aggregated scan of the key columns, one row to the driver."""
    return lengths(df, keys).agg(F.max("n")).first()[0] or 0


def join_groups(df: DataFrame, groups: DataFrame, keys: Keys) -> DataFrame:
    """Attach one row per group to the rows of ``df``; NULL is a key like any other."""
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(named, reduce(Column.__and__, same)).drop(*[f"_g_{k}" for k in keys])


def dense_index(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    name: str = "idx",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """0-based position of each row in its group. ``order`` must be a total order of the group."""
    if largest_group(df, keys) <= task_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    return _ranged_index(df, keys, order, name)


def _ranged_index(df: DataFrame, keys: Keys, order: Sequence[str], name: str) -> DataFrame:
    # Range partitions follow (keys, order), so a long series is spread over many of them.
    # The row's place in its partition is written down; the table read back never changes it.
    placed = land(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_run"))
        .withColumn("_before", F.coalesce(F.sum("_run").over(before), F.lit(0)))
        .drop("_run")
    )
    # read back from its file, the short table has a known size: Spark broadcasts it rather than shuffle all rows
    return (
        join_groups(placed, land(runs, "runs"), [*keys, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_part", "_first", "_before")
    )


def quantiles(
    df: DataFrame,
    keys: Keys,
    probs: Sequence[float],
    tie: Sequence[str] = ("idx",),
    value: str = "value",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as columns ``p0, p1, ...``.

    ``tie`` makes (value, tie) unique, so that equal values can still be split
    over range partitions.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value, *tie)
    if largest_group(known, keys) <= task_rows:
        got = known.groupBy(*keys).agg(F.percentile(value, F.lit(list(probs))).alias("_p"))
        return got.select(*keys, *[F.col("_p")[i].alias(f"p{i}") for i in range(len(probs))])
    sizes = land(lengths(known, keys, "_n"), "sizes")
    ranked = join_groups(_ranged_index(known, keys, [value, *tie], "_rank"), sizes, keys)
    place = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    ends = [e for p in place for e in (F.floor(p), F.ceil(p))]
    picked = (
        ranked.filter(F.col("_rank").isin(*ends))
        .groupBy(*keys)
        .agg(
            F.max("_n").alias("_n"),
            *[F.max(F.when(F.col("_rank") == e, F.col(value))).alias(f"_e{i}") for i, e in enumerate(ends)],
        )
    )
    read = picked.select(
        *keys,
        *[
            (
                # as percentile() above has it, so both plans give the same bits
                F.when(F.col(f"_e{2 * i}") == F.col(f"_e{2 * i + 1}"), F.col(f"_e{2 * i}")).otherwise(
                    (F.ceil(p) - p) * F.col(f"_e{2 * i}") + (p - F.floor(p)) * F.col(f"_e{2 * i + 1}")
                )
            ).alias(f"p{i}")
            for i, p in enumerate(place)
        ],
    )
    return land(read, "quantiles")  # one row a group, joined to all rows


def with_halo(df: DataFrame, block: int, reach: int) -> DataFrame:
    """Split each series into blocks of ``block`` positions, each with ``reach`` rows of its neighbours.

    Adds ``_block`` and ``_own``; filters on ``_own`` give every row back once.
    """
    if reach >= block:
        raise ValueError("a block must be longer than its halo")
    home = F.floor(F.col("idx") / block)
    near = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("idx") - reach) / block)),
        F.floor((F.col("idx") + reach) / block),
    )
    return df.withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == home)


def group_stats(df: DataFrame, keys: Keys, bounded: bool, **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row.

    ``bounded`` groups (subsets, whose size the plan limits) use a window; any
    others are aggregated with map-side combine and joined back, so no group
    is gathered in one task.
    """
    if bounded:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in aggregates.items()})
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), list(keys))
