"""Multifractal fluctuation analysis of series of any length.

``keys`` name one analysed series, as a rule ``("series_id",)``. Samples carry ``idx`` (dense,
0-based) and ``value``. A series is cut into blocks of positions, so one long series is spread over
many tasks, and a block is an array in its task: rows are never multiplied by scales. Segments that lie whole in
a block are measured there. Of others each block gives its part: count, mean, and slope and squared
residuals of its own straight line. Parts of a segment add up without loss of digits, as the parts of a line's residual
are a part's own residuals and the distance between two lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalefold.operators.arrays import (
    FLAT_STD,
    MIN_SEGMENTS,
    RIDGE,
    RMS_FLOOR,
    block_values,
    fit,
    kinds,
    list_rows,
    power_sums,
    roots,
    runs,
    slopes,
)
from scalefold.operators.grids import Q_GRID
from scalefold.operators.indexing import Keys, join_groups
from scalefold.session import land

# Positions of a block, and segments whose powers are summed in one step.
BLOCK = 32_768
STEP_SEGMENTS = 1 << 14


@dataclass(frozen=True)
class Method:
    """How a series is cut and what is taken off each segment.

    ``detrend`` 0 takes the mean off, 1 the ridge line. ``profile`` measures the running sum of the centred values instead of the
    values, ``bidirectional`` counts segments from the end of the series too; these are numbered -1, -2, ... from there.
    """

    detrend: int = 0
    profile: bool = False
    bidirectional: bool = False


def _per_series(samples: DataFrame, keys: Keys, scales: Sequence[int] | None, grids: DataFrame | None, method: Method, block: int) -> DataFrame | None:
    """What the blocks of a series have to know, one row a block: its ``scales``, length and, for profiles, mean and offset."""
    if scales is not None and not (method.profile or method.bidirectional):
        return None
    if grids is not None and "n" in grids.columns and not (method.profile or method.bidirectional):
        numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {block}"))
        return grids.filter("n > 0").select(*keys, F.explode(numbers).alias("_block"), F.col("scales").cast("array<int>").alias("_scales"))
    if scales is None and grids is None:  # the grid stands in every row
        grids = samples.groupBy(*keys).agg(F.max("scales").alias("scales"))
    totals = samples.groupBy(*keys, F.expr(f"idx div {block}").alias("_block")).agg(
        F.max("idx").alias("_last"), F.sum(F.col("value").cast("double")).alias("_sum"), F.count("value").alias("_n")
    )
    whole = totals.groupBy(*keys).agg(
        (F.max("_last") + 1).alias("_size"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = join_groups(totals, whole, keys)
    gained = F.coalesce(F.col("_sum"), F.lit(0.0)) - F.col("_n") * F.col("_mean")
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum(gained).over(before), F.lit(0.0)))
    if scales is not None:
        blocks = blocks.withColumn("_scales", F.lit(list(scales)).cast("array<int>"))
    else:
        blocks = join_groups(blocks, grids.select(*keys, F.col("scales").cast("array<int>").alias("_scales")), keys)
    return blocks.select(*keys, "_block", "_scales", "_size", "_mean", "_offset")


def _stream(samples: DataFrame, keys: Keys, about: DataFrame | None, block: int) -> DataFrame:
    """Samples by block, behind what is to be known of the block."""
    rows = samples.select(*keys, F.expr(f"idx div {block}").alias("_block"), "idx", F.col("value").cast("double").alias("value"))
    if about is not None:
        rows = rows.unionByName(about, allowMissingColumns=True)
    return rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.asc_nulls_first("idx"))


def _cut(x: np.ndarray, begin: int, s: int, origin: int) -> tuple[int, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Segments of ``s`` from ``origin`` on in the values ``x`` from position ``begin`` on.

    Gives the first whole segment and all whole ones as rows, and parts as (segment, place in it, values).
    """
    end = begin + len(x)
    start = min(max(begin, origin), end)
    first = max(0, -((origin - begin) // s))
    last = max(first, (end - origin) // s)
    low, high = origin + first * s, origin + last * s
    if last == first:  # no whole one; the values may still meet two
        edges = sorted({start, min(max(low, start), end), end})
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
        whole = x[:0].reshape(0, s)
    else:
        parts = [(a, b) for a, b in ((start, low), (high, end)) if b > a]
        whole = x[low - begin : high - begin].reshape(-1, s)
    return first, whole, [((a - origin) // s, (a - origin) % s, x[a - begin : b - begin]) for a, b in parts]


def _line(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, slope and squared residuals of the straight line through each row, and the squares of the positions."""
    n = x.shape[1]
    t = np.arange(n) - (n - 1) / 2.0
    squares = n * (n * n - 1.0) / 12.0
    mean = x.mean(axis=1)
    off = x - mean[:, None]
    slope = off @ t / squares if n > 1 else np.zeros(len(x))
    left = off - slope[:, None] * t
    return mean, slope, np.einsum("ij,ij->i", left, left), squares


def _whole(x: np.ndarray, detrend: int) -> np.ndarray:
    """Root mean square of whole segments; nan for one with a gap or without any spread."""
    n = x.shape[1]
    with np.errstate(invalid="ignore"):
        var = x.var(axis=1)
        real = np.sqrt(var) >= FLAT_STD
        rest = var
        if detrend:
            mean, slope, residuals, squares = _line(x)
            ridged = n * squares + RIDGE
            left = mean * RIDGE / ridged
            apart = slope * RIDGE / ridged
            rest = (residuals + n * left * left + apart * apart * squares) / n
        return np.where(real, np.sqrt(rest + RMS_FLOOR), np.nan)


PART = "array<struct<seg: long, x: double, n: long, mean: double, slope: double, rss: double>>"


def _blocks(
    samples: DataFrame, keys: Keys, scales: Sequence[int] | None, grids: DataFrame | None, method: Method, q: np.ndarray | None, block: int
) -> DataFrame:
    """Per block, scale and direction: whole segments, as ``rms`` or (with ``q``) summed powers, and ``parts`` of others.

    ``n_segments`` counts the whole segments with spread; ``first`` is the first whole one, ``tail`` the number of segments of
    the series where they are counted from its end.
    """
    about = _per_series(samples, keys, scales, grids, method, block)
    stream = _stream(samples, keys, about, block)
    types, headed = kinds(stream, *keys), about is not None
    key_types = [stream.schema[k].dataType for k in keys]

    def measured(key: tuple, table: pa.Table) -> Iterator[tuple]:
        own, at = key[-1] * block, 0
        grid, size, mean, offset = scales, None, None, None
        if headed:
            about_it = table.slice(0, 1).to_pylist()[0]
            grid, size, mean, offset = (about_it.get(c) for c in ("_scales", "_size", "_mean", "_offset"))
            at = 1
        rows = table.slice(at)
        if not rows.num_rows or not grid:
            return
        x = block_values(rows, own, int(rows.column("idx")[rows.num_rows - 1].as_py()) - own + 1)
        if method.profile:
            known = np.isfinite(x)
            x = np.where(known, offset + np.cumsum(np.where(known, x - (mean or 0.0), 0.0)), np.nan)
        for pos, s in enumerate(grid):
            for tail in (False, True) if method.bidirectional else (False,):
                first, whole, parts = _cut(x, own, s, size % s if tail else 0)
                rms = _whole(whole, method.detrend)
                good = np.isfinite(rms)
                kept = rms if q is None else _sums(rms[good], q)
                yield (
                    *key[:-1], pos, s, size // s if tail else None, first, int(good.sum()),
                    [None if np.isnan(v) else v for v in kept.tolist()], [_part(*p) for p in parts],
                )

    names = [*keys, "scale_pos", "s", "tail", "first", "n_segments", "kept", "parts"]
    schema = f"{types}scale_pos int, s int, tail long, first long, n_segments long, kept array<double>, parts {PART}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, table in runs(batches, [*keys, "_block"]):
            for row in measured(key, table):
                held.append(row)
                size += 16 + len(row[-2])
            if size > 1 << 19:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    from pyspark.sql.pandas.types import to_arrow_type

    part = pa.struct([("seg", pa.int64()), ("x", pa.float64()), ("n", pa.int64()), ("mean", pa.float64()), ("slope", pa.float64()), ("rss", pa.float64())])
    arrow = [*(to_arrow_type(t) for t in key_types), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(part)]

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow)], names=names)

    return stream.mapInArrow(run, schema)


def _part(seg: int, place: int, x: np.ndarray) -> dict:
    """One block's share of a segment; a gap leaves the count short, and the segment is dropped for it."""
    n = int(np.isfinite(x).sum())
    if n < len(x):
        return {"seg": seg, "x": 0.0, "n": n, "mean": 0.0, "slope": 0.0, "rss": 0.0}
    mean, slope, rss, _ = _line(x[None, :])
    return {"seg": seg, "x": place + (n - 1) / 2.0, "n": n, "mean": float(mean[0]), "slope": float(slope[0]), "rss": float(rss[0])}


def _sums(rms: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(q))
    for begin in range(0, len(rms), STEP_SEGMENTS):
        some = rms[begin : begin + STEP_SEGMENTS]
        total += power_sums(some, np.array([len(some)]), q)[0]
    return total


def _added(pieces: DataFrame, keys: Keys, detrend: int) -> DataFrame:
    """Segments that several blocks share: ``rms`` from their parts, full ones with any spread only."""
    by = [*keys, "scale_pos", "tail", "seg"]
    rows = pieces.select(*keys, "scale_pos", "s", "tail", F.explode("parts").alias("_p")).withColumn("seg", F.col("_p.seg"))
    gathered = rows.groupBy(*by).agg(
        F.max("s").alias("s"), F.sum("_p.n").alias("_n"), (F.sum(F.col("_p.n") * F.col("_p.mean")) / F.sum("_p.n")).alias("_m"),
        F.collect_list("_p").alias("_parts"),
    )
    s = F.col("s").cast("double")

    def squares(p: Column) -> Column:
        n = p["n"].cast("double")
        return n * (n * n - 1.0) / 12.0

    def total(term) -> Column:
        return F.aggregate("_parts", F.lit(0.0), lambda a, p: a + term(p))

    centre = (s - 1.0) / 2.0
    gathered = gathered.filter(F.col("_n") == F.col("s")).withColumns({
        "_v": total(lambda p: p["rss"] + p["slope"] * p["slope"] * squares(p) + p["n"] * (p["mean"] - F.col("_m")) * (p["mean"] - F.col("_m"))) / s,
        "_c": total(lambda p: p["slope"] * squares(p) + p["n"] * (p["x"] - centre) * (p["mean"] - F.col("_m"))),
    })
    if detrend:
        ss_x = s * s * (s * s - 1.0) / 12.0
        gathered = gathered.withColumns({"_slope": s * F.col("_c") / (ss_x + RIDGE), "_left": F.col("_m") * RIDGE / (ss_x + RIDGE)})

        def rest(p: Column) -> Column:
            apart = p["mean"] - F.col("_m") - F.col("_slope") * (p["x"] - centre) + F.col("_left")
            turn = p["slope"] - F.col("_slope")
            return p["rss"] + p["n"] * apart * apart + turn * turn * squares(p)

        gathered = gathered.withColumn("_r", total(rest) / s)
    else:
        gathered = gathered.withColumn("_r", F.col("_v"))
    return gathered.filter(F.sqrt("_v") >= FLAT_STD).select(*by, "s", F.sqrt(F.col("_r") + RMS_FLOOR).alias("rms"))


def segment_rms(
    samples: DataFrame, keys: Keys, scales: Sequence[int] | None = None, detrend: int = 0,
    profile: bool = False, bidirectional: bool = False, grids: DataFrame | None = None, block: int | None = None,
) -> DataFrame:
    """M3, M4, M5. ``(keys, scale_pos, s, seg, rms)``: root mean square around the mean (or the ridge line) of each full segment.

    ``scales`` is a fixed grid; None takes them from ``grids(keys, scales, [n])``, n the length of the series, else from the rows' own column ``scales``.
    A segment with a NULL value, or without any spread, is left out. See ``Method`` for the options.
    """
    method = Method(detrend, profile, bidirectional)
    pieces = land(_blocks(samples, keys, scales, grids, method, None, block or BLOCK), "segments")
    whole = pieces.select(*keys, "scale_pos", "s", "tail", "first", F.posexplode("kept").alias("_at", "rms")).filter(F.col("rms").isNotNull())
    whole = whole.withColumn("seg", F.col("first") + F.col("_at"))
    both = whole.select(*keys, "scale_pos", "s", "tail", "seg", "rms").unionByName(
        _added(pieces, keys, detrend).select(*keys, "scale_pos", "s", "tail", "seg", "rms")
    )
    # from the end the last segment is -1
    seg = F.when(F.col("tail").isNull(), F.col("seg")).otherwise(F.col("seg") - F.col("tail"))
    return both.select(*keys, "scale_pos", "s", seg.alias("seg"), "rms")


def fluctuation_rows(
    samples: DataFrame, keys: Keys, scales: Sequence[int] | None = None, q_grid: Sequence[float] = Q_GRID, detrend: int = 0,
    profile: bool = False, bidirectional: bool = False, grids: DataFrame | None = None, block: int | None = None,
) -> DataFrame:
    """M6, M7. One row per scale with F(q, s) over the whole q grid as an array ``f``; arguments as in ``segment_rms``.

    A block sums the powers of its whole segments, all q at once, so neither segments nor the grid
    become rows. F is NULL where it is not positive and finite.
    """
    q = np.asarray(q_grid, dtype=float)
    method = Method(detrend, profile, bidirectional)
    pieces = land(_blocks(samples, keys, scales, grids, method, q, block or BLOCK), "powers")
    by = [*keys, "scale_pos"]
    shared = _added(pieces, keys, detrend).groupBy(*by, F.pmod("seg", F.lit(64)).alias("_salt")).agg(
        F.max("s").alias("s"), F.count(F.lit(1)).alias("n_segments"), F.collect_list("rms").alias("_x")
    )
    types = kinds(pieces, *by, "s", "n_segments")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(values, count, rows):
            return power_sums(np.asarray(values, dtype=float), count, q)

        return list_rows(batches, "_x", [*by, "s", "n_segments"], "kept", len(q), run)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(values, count, rows):
            parts = np.asarray(values.flatten(), dtype=float).reshape(-1, len(q))
            return roots(np.add.reduceat(parts, np.cumsum(count) - count, axis=0), np.asarray(rows.column("n_segments")), q)

        return list_rows(batches, "_q", [*by, "s", "n_segments"], "f", len(q), run)

    edges = shared.select(*by, "s", "n_segments", "_x").mapInArrow(sums, f"{types}kept array<double>")
    whole = pieces.filter("n_segments > 0").select(*by, "s", "n_segments", "kept")
    added = whole.unionByName(edges).groupBy(*by).agg(
        F.max("s").alias("s"), F.sum("n_segments").alias("n_segments"), F.collect_list("kept").alias("_q")
    )
    added = added.filter(F.col("n_segments") >= MIN_SEGMENTS)
    return added.mapInArrow(joined, f"{types}f array<double>")


def fluctuation(samples: DataFrame, keys: Keys, scales: Sequence[int] | None = None, q_grid: Sequence[float] = Q_GRID, **how) -> DataFrame:
    """F(q, s) in long form, one row per scale and q."""
    return fluctuation_rows(samples, keys, scales, q_grid, **how).select(
        *keys, "scale_pos", "s", "n_segments", F.posexplode("f").alias("q_pos", "f")
    )


def spectrum(fluct: DataFrame, keys: Keys, q_grid: Sequence[float] = Q_GRID) -> DataFrame:
    """M8-M12. h(q), tau, alpha and f(alpha) from ``fluctuation_rows``, one row per q; undefined values are NULL.

    A series has one row per scale here, a few dozen at most. They are gathered
    once, and the regressions of all q of many series are fitted in one step.
    """
    q = np.asarray(q_grid, dtype=float)
    gathered = fluct.groupBy(*keys).agg(
        F.collect_list(F.struct(F.ln(F.col("s").cast("double")).alias("x"), "f")).alias("_r")
    )

    def fitted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(values, count, rows):
            x, f = values.flatten()
            f = np.asarray(f.flatten().fill_null(np.nan), dtype=float).reshape(-1, len(q))
            n, h = fit(np.asarray(x, dtype=float), f, count)
            return np.stack([n, h, *slopes(h, q)], axis=2)

        return list_rows(batches, "_r", list(keys), "_v", 5 * len(q), run)

    fitted = gathered.mapInArrow(fitted_rows, f"{kinds(gathered, *keys)}_v array<double>")
    rows = fitted.select(*keys, "_v", F.explode(F.sequence(F.lit(0), F.lit(len(q) - 1))).alias("q_pos"))

    def value(k: int):
        return F.get("_v", 5 * F.col("q_pos") + k)

    return rows.select(
        *keys,
        value(0).cast("bigint").alias("n_scales"),
        "q_pos",
        F.lit(list(q_grid))[F.col("q_pos")].alias("q"),
        *[value(k).alias(name) for k, name in enumerate(("h", "tau", "alpha", "f_alpha"), 1)],
    )


def singularity(h_rows: DataFrame, keys: Keys) -> DataFrame:
    """M10-M12. tau = h q - 1; alpha over neighbouring valid q; f(alpha) at the right end."""
    earlier = Window.partitionBy(*keys).orderBy("q_pos").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(F.col("h").isNotNull(), F.struct("tau", "q"))
    return (
        h_rows.withColumn("tau", F.col("h") * F.col("q") - 1.0)
        .withColumn("_p", F.last(valid, ignorenulls=True).over(earlier))
        .withColumn("alpha", F.try_divide(F.col("tau") - F.col("_p.tau"), F.col("q") - F.col("_p.q")))
        .withColumn("f_alpha", F.col("q") * F.col("alpha") - F.col("tau"))
        .drop("_p")
    )


def dimension(spec: DataFrame, keys: Keys) -> DataFrame:
    """M13. D_f = mean alpha, with the mean h and the number of valid q."""
    return spec.groupBy(*keys).agg(
        F.avg("alpha").alias("d_f"),
        F.avg("h").alias("mean_h"),
        F.count("h").alias("n_valid_q"),
        F.max("n_scales").alias("n_scales_used"),
    )


def measure(samples: DataFrame, keys: Keys, scales: Sequence[int] | None = None, detrend: int = 0, **how) -> DataFrame:
    """M3-M12 in one call: samples to spectrum rows; other options as in ``segment_rms``."""
    return spectrum(fluctuation_rows(samples, keys, scales, detrend=detrend, **how), keys)


# Fixed values of the reliability test.
MIN_VALID_RATIO = 0.6
RISE_TOLERANCE = 0.05


def reliable(
    spec: DataFrame,
    keys: Keys,
    min_ratio: float = MIN_VALID_RATIO,
    tolerance: float = RISE_TOLERANCE,
    monotone: bool = True,
) -> DataFrame:
    """M14. Enough valid h(q), and h(q) nowhere rising faster than the tolerance."""
    earlier = Window.partitionBy(*keys).orderBy("q_pos").rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        spec.select(*keys, "q_pos", "q", "h")
        .withColumn("_h", F.last("h", ignorenulls=True).over(earlier))
        .withColumn("_q", F.last(F.when(F.col("h").isNotNull(), F.col("q")), ignorenulls=True).over(earlier))
        .withColumn("_rise", F.try_divide(F.col("h") - F.col("_h"), F.col("q") - F.col("_q")))
    )
    out = stepped.groupBy(*keys).agg(
        (F.count("h") / F.count(F.lit(1))).alias("valid_ratio"),
        F.max("_rise").alias("max_rise"),
    )
    shape = F.coalesce(F.col("max_rise") <= tolerance, F.lit(False)) if monotone else F.lit(True)
    return out.withColumn("is_valid", (F.col("valid_ratio") >= min_ratio) & shape)
