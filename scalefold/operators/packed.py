"""Windows measured as arrays: one shuffle of samples, no rows multiplied by scales.

Samples are placed by (series, block of positions), each block with a halo as long as the longest window,
so a window lies whole in the block it starts in. Windows are sent to their blocks
ahead of the samples. A task cuts them out of the block's array and measures windows
of one size together: segment moments of all scales, F(q, s), the regressions and what sums them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.operators.arrays import FLAT_STD, MIN_SEGMENTS, RMS_FLOOR, block_values, fit, numbers, power_sums, roots, runs, slopes
from scalefold.operators.cleaning import STRAIN_GAIN, Z_FLOOR
from scalefold.operators.denoise import STRAIN_WIDTH
from scalefold.operators.grids import Q_GRID
from scalefold.operators.indexing import join_groups

#: Blocks are at least this long, and at least this many times as long as a window.
BLOCK, BLOCK_WINDOWS = 8192, 4
#: Values of windows measured in one step, and segments whose powers are taken at once.
STEP_VALUES, STEP_SEGMENTS = 1 << 18, 1 << 14
#: Numbers kept of a spectrum: scales used, h, tau, alpha, f(alpha), each for every q.
KINDS = ("n_scales", "h", "tau", "alpha", "f_alpha")


def _spread(x: np.ndarray) -> np.ndarray:
    known = np.maximum(np.isfinite(x).sum(axis=1, keepdims=True), 1)
    mean = np.nansum(x, axis=1, keepdims=True) / known
    return np.sqrt(np.nansum((x - mean) ** 2, axis=1, keepdims=True) / known)


def _unit_std(x: np.ndarray) -> np.ndarray:
    std = _spread(x)
    return np.where(std > 0.0, x, np.nan) / np.where(std > 0.0, std, 1.0)


def _z_score(x: np.ndarray) -> np.ndarray:
    known = np.maximum(np.isfinite(x).sum(axis=1, keepdims=True), 1)
    return (x - np.nansum(x, axis=1, keepdims=True) / known) / (_spread(x) + Z_FLOOR)


def _moving_mean(x: np.ndarray) -> np.ndarray:
    reach = STRAIN_WIDTH // 2
    padded = np.pad(x * STRAIN_GAIN, ((0, 0), (reach, reach)), mode="edge")
    n = x.shape[1]
    return sum(padded[:, k : k + n] for k in range(STRAIN_WIDTH)) / STRAIN_WIDTH


#: Recipes of ``denoise`` on a table of windows, one a row, nan for NULL; others come as denoised rows.
RECIPES = {"unit_std": _unit_std, "z_score": _z_score, "strain": _moving_mean, "": lambda x: x}


def fluctuations(x: np.ndarray, scales: Sequence[int], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F (window, scale, q), nan where undefined, and the segments it rests on (window, scale)."""
    count = np.zeros((len(x), len(scales)), np.int64)
    f = np.full((len(x), len(scales), len(q)), np.nan)
    for at, s in enumerate(scales):
        many = x.shape[1] // s
        if many < MIN_SEGMENTS:
            continue
        cut = x[:, : many * s].reshape(len(x), many, s)
        var = cut.var(axis=2)
        with np.errstate(invalid="ignore"):
            real = np.sqrt(var) >= FLAT_STD
        count[:, at] = real.sum(axis=1)
        step = max(1, STEP_SEGMENTS // many)
        for begin in range(0, len(x), step):
            n = count[begin : begin + step, at]
            rows = np.flatnonzero(n >= MIN_SEGMENTS)
            if len(rows):
                chosen = real[begin + rows]
                rms = np.sqrt(var[begin + rows][chosen] + RMS_FLOOR)
                f[begin + rows, at] = roots(power_sums(rms, n[rows], q), n[rows], q)
    return f, count


def measured(x: np.ndarray, scales: Sequence[int], q: np.ndarray) -> dict[str, np.ndarray]:
    """Windows of one size and grid, those with an F at any scale: spectra and what sums them up."""
    f, count = fluctuations(x, scales, q)
    rows = np.flatnonzero((count >= MIN_SEGMENTS).any(axis=1))
    f, count = f[rows], count[rows]
    if not len(rows):
        return {"row": rows}
    ln = np.tile(np.log(np.asarray(scales, dtype=float)), len(rows))
    n, h = fit(ln, f.reshape(-1, len(q)), np.full(len(rows), len(scales)))
    tau, alpha, f_alpha = slopes(h, q)
    known, ends = np.isfinite(h).sum(axis=1), np.isfinite(alpha).sum(axis=1)
    with np.errstate(invalid="ignore"):
        mean_h, d_f = np.nansum(h, axis=1) / known, np.nansum(alpha, axis=1) / ends
    return {
        "row": rows, "spectrum": np.concatenate([n, h, tau, alpha, f_alpha], axis=1), "d_f": d_f, "mean_h": mean_h,
        "n_valid_q": known, "n_scales_used": n.max(axis=1).astype(np.int64), "f": f, "count": count,
    }


WINDOW = ("series_id", "subset_id")
#: What a step may give of a window besides its key; ``spectrum`` holds all KINDS, ``h`` that one alone.
COLUMNS = {
    "d_f": "double", "mean_h": "double", "n_valid_q": "long", "n_scales_used": "long", "spectrum": "array<double>",
    "scale_pos": "array<int>", "s": "array<int>", "n_segments": "array<long>", "f": "array<double>", "h": "array<double>",
}
#: All there is to know of a window, and the numbers that sum it up.
WHOLE = tuple(c for c in COLUMNS if c != "h")
SUMMARY = ("d_f", "mean_h", "n_valid_q", "n_scales_used")


def _schema(rows: DataFrame, columns: Sequence[str]) -> str:
    kinds = "".join(f", {c} {COLUMNS[c]}" for c in columns)
    return f"series_id {rows.schema['series_id'].dataType.simpleString()}, subset_id int{kinds}"


def _known(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


class _Queue:
    """Windows waiting for others of their size, recipe and grid; all is measured, ``columns`` leave the task."""

    def __init__(self, q: np.ndarray, columns: Sequence[str]):
        self.q, self.columns, self.waiting, self.size = q, list(columns), {}, 0

    def add(self, series: str, subset: int, x: np.ndarray, recipe: str, scales: tuple[int, ...]) -> None:
        self.waiting.setdefault((len(x), recipe, scales), []).append((series, subset, x))
        self.size += len(x)

    def emptied(self) -> Iterator[pa.RecordBatch]:
        nq = len(self.q)
        for (_, recipe, scales), held in self.waiting.items():
            if not scales:
                continue
            with np.errstate(invalid="ignore"):
                got = measured(RECIPES[recipe](np.stack([x for *_, x in held])), scales, self.q)
            n = len(got["row"])
            if not n:
                continue
            made = {
                "d_f": lambda: _known(got["d_f"]), "mean_h": lambda: _known(got["mean_h"]),
                "n_valid_q": lambda: pa.array(got["n_valid_q"].astype(np.int64)), "n_scales_used": lambda: pa.array(got["n_scales_used"]),
                "spectrum": lambda: numbers(got["spectrum"]), "h": lambda: numbers(np.ascontiguousarray(got["spectrum"][:, nq : 2 * nq])),
                "scale_pos": lambda: numbers(np.tile(np.arange(len(scales), dtype=np.int32), (n, 1))),
                "s": lambda: numbers(np.tile(np.array(scales, dtype=np.int32), (n, 1))),
                "n_segments": lambda: numbers(got["count"]), "f": lambda: numbers(got["f"]),
            }
            key = [pa.array([held[i][0] for i in got["row"]]), pa.array([held[i][1] for i in got["row"]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*key, *(made[c]() for c in self.columns)], names=[*WINDOW, *self.columns])
        self.waiting, self.size = {}, 0


def _stream(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``rows(series_id, part, idx, value)`` behind ``windows(series_id, part, subset_id, start, size, recipe, scales)`` of the same part."""
    both = rows.select("series_id", "part", "idx", F.col("value").cast("double").alias("value")).unionByName(
        windows.select("series_id", "part", "subset_id", "start", "size", "recipe", "scales"), allowMissingColumns=True
    )
    # windows have no idx, so they come first
    return both.repartition("series_id", "part").sortWithinPartitions("series_id", "part", "idx")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Windows ``(series, subset, values, recipe, scales)`` that lie whole in the rows of their part."""
    for (series, _), table in runs(batches, ("series_id", "part")):
        asked = table.column("subset_id").length() - table.column("subset_id").null_count
        if not asked:
            continue
        windows, rows = table.slice(0, asked), table.slice(asked)
        if not rows.num_rows:
            continue
        idx = rows.column("idx").to_numpy()
        first = int(idx[0])
        values = block_values(rows, first, int(idx[-1]) - first + 1)
        columns = (windows.column(c).to_pylist() for c in ("subset_id", "start", "size", "recipe", "scales"))
        for subset, start, size, recipe, scales in zip(*columns):
            x = values[start - first : start - first + size]
            if start >= first and len(x) == size:
                yield series, subset, x, recipe, scales


def _measure(stream: DataFrame, q_grid: Sequence[float], columns: Sequence[str]) -> DataFrame:
    q = np.asarray(q_grid, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = _Queue(q, columns)
        for series, subset, x, recipe, scales in _cut(batches):
            # a scale without two segments has no F
            queue.add(series, subset, x, recipe, tuple(s for s in scales if MIN_SEGMENTS * s <= len(x)))
            if queue.size >= STEP_VALUES:
                yield from queue.emptied()
        yield from queue.emptied()

    return stream.mapInArrow(run, _schema(stream, columns))


def _placed(samples: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    block = max(BLOCK, BLOCK_WINDOWS * longest)
    first = F.greatest(F.lit(0), F.expr(f"(idx - {longest - 1}) div {block}"))
    rows = samples.select("series_id", "idx", "value", F.explode(F.sequence(first, F.expr(f"idx div {block}"))).alias("part"))
    placed = windows.filter(F.col("start").isNotNull()).withColumn("part", F.expr(f"start div {block}"))
    return _stream(rows, placed)


def measure_windows(
    samples: DataFrame, windows: DataFrame, longest: int, q_grid: Sequence[float] = Q_GRID, columns: Sequence[str] = WHOLE
) -> DataFrame:
    """M3-M14 of every window of ``samples(series_id, idx, value)``, one row per window that has an F.

    ``windows(series_id, subset_id, start, size, recipe, scales)``, none longer than ``longest``; ``recipe`` names one of
    RECIPES. A NULL value makes the segments that hold it undefined. Spark cannot tell a task which of its ``columns`` are read
    later; named here, the others need not leave it.
    """
    return _measure(_placed(samples, windows, longest), q_grid, columns)


def pack_rows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """K12. Denoised ``rows(series_id, subset_id, idx, value)`` as one row a window: its positions and values in order, its size and scales.

    A window is whole in its row, so what is measured later reads the written table without a shuffle.
    ``windows`` carry ``family``, ``start``, ``size`` and ``scales``; those without a start are left out.
    """
    held = rows.groupBy(*WINDOW).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_rows"))
    own = windows.filter(F.col("start").isNotNull()).select(*WINDOW, "family", "size", "scales")
    columns = [F.col("_rows.idx").alias("idx"), F.col("_rows.value").cast("array<double>").alias("value")]
    return join_groups(held, own, list(WINDOW)).select(*WINDOW, "family", "size", "scales", *columns)


def pack_windows(samples: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    """The same for windows cut and denoised where the samples lie, by one of RECIPES: ``samples`` are shuffled once, their copies in windows never.

    ``windows`` as for ``measure_windows``, with their ``family``; ``samples`` have dense positions, as windows count on. A NULL series has no windows.
    """
    own = windows.filter(F.col("series_id").isNotNull()).withColumn("recipe", F.struct("recipe", "family"))
    stream = _placed(samples, own, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            series, subset, x, named, scales = zip(*held)
            sizes = np.array([len(v) for v in x])
            clean: list[np.ndarray] = [np.zeros(0)] * len(x)
            for size, recipe in {(len(v), r["recipe"]) for v, r in zip(x, named)}:
                rows = [k for k, (v, r) in enumerate(zip(x, named)) if len(v) == size and r["recipe"] == recipe]
                with np.errstate(invalid="ignore"):
                    for k, v in zip(rows, RECIPES[recipe](np.stack([x[k] for k in rows]))):
                        clean[k] = v
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            place = pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int64))
            columns = [
                pa.array(series), pa.array(subset, pa.int32()), pa.array([r["family"] for r in named], pa.string()), pa.array(sizes.astype(np.int32)),
                pa.array(scales, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, place), pa.ListArray.from_arrays(offsets, _known(np.concatenate(clean))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[*WINDOW, "family", "size", "scales", "idx", "value"])

        size = 0
        for one in _cut(batches):
            held.append(one)
            size += len(one[2])
            if size >= STEP_VALUES:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    name = stream.schema["series_id"].dataType.simpleString()
    return stream.mapInArrow(run, f"series_id {name}, subset_id int, family string, size int, scales array<int>, idx array<bigint>, value array<double>")


def unpacked(packed: DataFrame) -> DataFrame:
    """The rows ``(series_id, subset_id, family, size, idx, value)`` of packed windows."""
    return packed.select(*WINDOW, "family", "size", F.inline(F.arrays_zip("idx", "value")))


def measure_packed(packed: DataFrame, q_grid: Sequence[float] = Q_GRID, columns: Sequence[str] = WHOLE) -> DataFrame:
    """M3-M14 of packed windows, one row per window that has an F; a window that lacks its first or last row has none."""
    q = np.asarray(q_grid, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = _Queue(q, columns)
        for batch in batches:
            series, subset, sizes, scales = (batch.column(c).to_pylist() for c in (*WINDOW, "size", "scales"))
            for k, size in enumerate(sizes):
                idx, value = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("idx", "value"))
                if not len(idx) or idx[0] > 0 or idx[-1] < size - 1:
                    continue
                x = np.full(int(idx[-1]) + 1, np.nan)
                x[idx] = value
                queue.add(series[k], subset[k], x[:size], "", tuple(s for s in scales[k] if MIN_SEGMENTS * s <= size))
                if queue.size >= STEP_VALUES:
                    yield from queue.emptied()
        yield from queue.emptied()

    own = packed.select(*WINDOW, "size", "scales", "idx", "value")
    return own.mapInArrow(run, _schema(packed, columns))


def measure_rows(
    rows: DataFrame, windows: DataFrame, q_grid: Sequence[float] = Q_GRID, columns: Sequence[str] = WHOLE
) -> DataFrame:
    """The same for windows that come as denoised ``rows(series_id, subset_id, idx, value)``, each counted from 0."""
    return measure_packed(pack_rows(rows, windows), q_grid, columns)


def spectrum_rows(measures: DataFrame, q_grid: Sequence[float] = Q_GRID) -> DataFrame:
    """One row per window and q, as ``fluctuation.spectrum`` gives them; of measures with ``h`` alone, without the other kinds."""
    n = len(q_grid)
    whole = "spectrum" in measures.columns
    rows = measures.select(*WINDOW, "spectrum" if whole else "h", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_pos"))
    q = F.lit(list(q_grid))[F.col("q_pos")].alias("q")
    if not whole:
        return rows.select(*WINDOW, "q_pos", q, F.get("h", F.col("q_pos")).alias("h"))
    columns = {name: F.get("spectrum", F.col("q_pos") + k * n) for k, name in enumerate(KINDS)}
    return rows.select(
        *WINDOW, columns["n_scales"].cast("bigint").alias("n_scales"), "q_pos", q, *[columns[name].alias(name) for name in KINDS[1:]]
    )


def fluctuation_rows(measures: DataFrame, n_q: int = len(Q_GRID)) -> DataFrame:
    """One row per window and scale with F over the q grid, as ``fluctuation.fluctuation_rows`` gives them."""
    each = F.arrays_zip("scale_pos", "s", "n_segments")
    rows = measures.select("series_id", "subset_id", "f", F.posexplode(each).alias("_at", "_r")).filter(F.col("_r.n_segments") >= MIN_SEGMENTS)
    return rows.select("series_id", "subset_id", "_r.scale_pos", "_r.s", "_r.n_segments", F.slice("f", F.col("_at") * n_q + 1, F.lit(n_q)).alias("f"))
