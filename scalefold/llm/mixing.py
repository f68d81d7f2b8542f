"""Mixing sources to target weights by entropy balancing.

Document rates stay as close as possible (in relative entropy) to one copy each
while the words of every source meet their target. The solution tilts rates
exponentially, ``rate = min(cap, exp(tilt * size / scale))`` with one tilt a source,
the dual variable of its word constraint. The dual is convex; distributed Newton
steps, kept inside a shrinking bracket, solve all constraints at once on the
table of (source, size, documents). Rates are then rounded to whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scalefold.session import land

#: Words of a source may miss the target of the rates by this share.
TOLERANCE = 1e-6
STEPS = 60
#: Documents of one size ranked in one group.
BUCKET = 256
_SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    trimmed = F.regexp_replace(text, rf"^{_SPACES}|{_SPACES}\z", "")
    parts = F.size(F.split(trimmed, _SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(parts).cast("long")


def _key(source: str) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[float, ...]) -> DataFrame:
    """A weight for each source: the cycle repeated over the sources by code point, null last."""
    names = sources.select(source).distinct()
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1  # one row a source
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    return names.select(source, F.get(weights, F.pmod(rank, F.lit(len(cycle)))).alias("weight"))


def targets(sizes: DataFrame, cap: float) -> DataFrame:
    """``target`` for each row of (source_size, weight): all words shared by weight, at most ``cap`` times a source.

    What a capped source cannot take is shared by weight among the rest until
    none is above. In the order of cap / weight the capped sources come first,
    so one pass over the sources finds them. A weight that is null or not
    positive takes nothing, unless all others are full.
    """
    room = F.col("source_size") * cap
    order = W.orderBy((room / F.col("weight")).asc_nulls_last(), "weight", "_source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    left = total - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    ranked = sizes.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight"))).withColumn("_level", level)
    ranked = ranked.withColumn("_full", F.coalesce(F.col("weight") * F.col("_level") > room, F.lit(False)))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(W.partitionBy())
    share = F.when(F.col("_full"), room).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0)))
    return ranked.withColumn("target", share).drop("_level", "_full")


def _solved(table: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``(_source, tilt, scale)``: the dual solution, one Newton step for all sources a round."""
    state = land(
        goals.withColumns({"tilt": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")),
                           "scale": F.greatest(F.col("largest").cast("double"), F.lit(1.0)), "done": F.lit(False)}),
        "tilts",
    )
    rate = F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))))
    words = F.col("docs") * F.col("size")
    for _ in range(STEPS):
        moved = (
            table.join(state.filter("not done"), "_source")
            .withColumn("rate", rate)
            .groupBy("_source")
            .agg(F.sum(words * F.col("rate")).alias("got"),
                 F.sum(F.when(F.col("rate") < cap, words * F.col("rate") * F.col("size") / F.col("scale")))
                 .alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        limit = 2 * F.abs("tilt") + 1  # no step beyond: far from the solution the slope says little
        newton = F.greatest(F.least(newton, limit), -limit)
        middle = (
            F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1)
            .when(F.col("high") == float("inf"), F.col("low") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        met = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target"), F.lit(True))
        step = (
            state.join(moved, "_source", "left")
            .withColumns({"met": F.col("done") | met, "gap": gap})
            .withColumns({"low": low, "high": high})
            .withColumn("tilt", F.when(F.col("met"), F.col("tilt")).when(inside, newton).otherwise(middle))
            .select("_source", "tilt", "low", "high", "scale", "target", F.col("met").alias("done"))
        )
        state = land(step, "tilts")
        if state.filter("not done").isEmpty():
            break
    return state.select("_source", "tilt", "scale")


def _whole_copies(rows: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies for every size of one source, from the largest size down: each size takes the whole
    number of copies that brings the words so far closest to what the rates ask for."""
    rows = rows.sort_values("size", ascending=False)
    size, docs = rows["size"].to_numpy(), rows["docs"].to_numpy()
    asked = np.cumsum(size * docs * rows["rate"].to_numpy())
    copies = np.zeros(len(rows), np.int64)
    taken = 0.0
    for i, (s, n) in enumerate(zip(size.tolist(), docs.tolist())):
        if s > 0:
            copies[i] = min(max(round((asked[i] - taken) / s), 0), int(cap) * n)
            taken += s * int(copies[i])
    return rows.assign(copies=copies)[["_source", "size", "copies", "docs"]]


def mix(
    documents: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cap: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every document row with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``weights`` is ``(<source>, weight)``, one row a source, null a source of its own; sources
    without a row weigh nothing. ``taken`` is ``copies * size``; copies lie between 0
    and ``cap``. Texts that are null, empty or without words have size 0 and no
    copies. Which documents of one source and size get a copy more is decided by
    a hash of the id, so runs agree; repeated rows count as documents of their
    own. Empty tables give empty results.

    Everything but the last join works on (source, size, documents): a source of
    w words has fewer than sqrt(2 w) + 1 sizes, which bounds the group that is rounded in
    one piece. A hot size is ranked in buckets of about BUCKET documents.
    """
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    keep = [c for c in (documents.columns if carry is None else carry) if c not in added]
    sized = land(
        documents.select(*keep, F.col(id_col).alias("_id"), _key(source).alias("_source"),
                         word_count(text).alias("size")),
        "sized",
    )
    table = land(sized.groupBy("_source", "size").agg(F.count("*").alias("docs")), "sizes")
    totals = table.groupBy("_source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.max("size").alias("largest")
    )
    weighed = weights.select(_key(source).alias("_source"), "weight")
    goals = land(targets(totals.join(weighed, "_source", "left"), float(cap)), "targets")
    # a full source takes every document at the cap; the rest are solved
    full = F.col("target") >= F.col("source_size") * cap * (1 - TOLERANCE)
    open_ = goals.filter(~full & (F.col("target") > 0)).select("_source", "target", "largest")
    tilts = _solved(table, open_, float(cap))
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))))
    rated = (
        table.join(goals.select("_source", "source_size", "target"), "_source")
        .join(tilts, "_source", "left")
        .withColumn("rate", F.when(F.col("target") <= 0, 0.0).when(full, float(cap)).otherwise(rate))
        .select("_source", "size", "docs", "rate")
    )

    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        return _whole_copies(rows, cap)

    copies = rated.groupBy("_source").applyInPandas(rounded, "_source string, size long, copies long, docs long")
    copies = land(copies, "copies")
    rated = rated.drop("docs").join(copies, ["_source", "size"]).join(goals.select("_source", "source_size", "target"), "_source")
    # each document gets copies div docs; the remainder goes to the first by hash, bucket by bucket
    base, extra = F.floor(F.col("copies") / F.col("docs")).cast("long"), F.col("copies") % F.col("docs")
    draw = F.xxhash64(F.lit("mix"), "_id")
    marked = sized.join(rated, ["_source", "size"]).withColumns(
        {"base": base, "extra": extra, "draw": draw,
         "bucket": F.pmod(draw, F.ceil(F.col("docs") / BUCKET).cast("long"))}
    ).repartition("_source", "size", "bucket")  # a hot size goes on in buckets
    held = marked.groupBy("_source", "size", "bucket").agg(
        F.count("*").alias("here"), F.first("docs").alias("all"), F.first("extra").alias("more")
    )
    upto = F.sum("here").over(W.partitionBy("_source", "size").orderBy("bucket"))
    quota = held.withColumn("upto", upto).select(
        "_source", "size", "bucket",
        (F.floor(F.col("more") * F.col("upto") / F.col("all"))
         - F.floor(F.col("more") * (F.col("upto") - F.col("here")) / F.col("all"))).alias("quota"),
    )
    rank = F.row_number().over(W.partitionBy("_source", "size", "bucket").orderBy("draw", "_id"))
    out = marked.join(quota, ["_source", "size", "bucket"]).withColumn(
        "copies", (F.col("base") + (rank <= F.col("quota")).cast("long"))
    )
    return out.select(*keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
