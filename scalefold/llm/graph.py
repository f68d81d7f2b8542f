"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.session import land


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(code), F.bit_xor("u"), F.bit_xor("v")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the least node it can reach.

    Large-star and small-star rounds: each turns the neighbours of a node to the
    least of them, so paths shrink by a constant factor a round. Only minima per
    node are shuffled besides the links, and every round is a written table.
    """
    edges = land(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links"
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        # small star: a node and its lower neighbours go to the least of them
        large = land(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = land(
            small.select("u", F.col("m").alias("v"))
            .union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        was, now = _digest(edges), _digest(after)
        edges = after
        if was == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
