"""Series and lists as numpy arrays inside tasks, and the formulas of the method on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Fixed values of the method.
RMS_FLOOR = 1e-12
FLAT_STD = 1e-10
RIDGE = 1e-5
MIN_SEGMENTS = 2
MIN_SCALES = 4
MIN_Q = 4

# List items worked on in one step.
STEP_VALUES = 1 << 14


def kinds(df: DataFrame, *names: str) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def runs(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values, rows) for each run of rows equal in ``names``; a run may go on over several batches."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None

    def table() -> pa.Table:
        return pa.Table.from_batches(held)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in names:
            a, b = batch.column(name).slice(0, n - 1), batch.column(name).slice(1)
            apart = pc.or_(pc.not_equal(a, b).fill_null(False), pc.xor(a.is_null(), b.is_null()))
            change[1:] |= np.asarray(apart, dtype=bool)
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for begin, end in zip(edges, edges[1:]):
            mine = tuple(batch.column(name)[begin].as_py() for name in names)
            if held and mine != key:
                yield key, table()
                held = []
            key = mine
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key, table()


def block_values(rows: pa.Table, first: int, length: int) -> np.ndarray:
    """Values by position from ``first`` on; nan where there is none."""
    out = np.full(length, np.nan)
    at = rows.column("idx").to_numpy() - first
    out[at] = np.asarray(rows.column("value").to_pandas(), dtype=float)
    return out


def numbers(table: np.ndarray) -> pa.Array:
    """Rows of a table as lists, nan as null."""
    flat = table.reshape(len(table), -1)
    mask = np.isnan(flat.ravel()) if flat.dtype.kind == "f" else None
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel(), mask=mask))


def run_sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums over runs of ``count`` rows each; runs of one length are summed at once, in the same order."""
    if len(count) and (count == count[0]).all() and count[0] > 0:
        return values.reshape(len(count), int(count[0]), -1).sum(axis=1)
    return np.add.reduceat(values, np.cumsum(count) - count, axis=0)


def _even_step(q: np.ndarray) -> float | None:
    """The step of a grid that goes through zero in equal steps, else None."""
    if len(q) < 2 or not (q == 0.0).any() or q[1] <= q[0]:
        return None
    step = (q[-1] - q[0]) / (len(q) - 1)
    places = np.arange(len(q)) - int(np.flatnonzero(q == 0.0)[0])
    return float(step) if np.allclose(q, places * step, rtol=1e-14, atol=0.0) else None


def power_sums(rms: np.ndarray, count: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For runs of ``count`` values each: the sum of x^q, of ln x^2 where q is zero.

    On an even grid x^q goes on from its neighbour by one product, and runs of one length are summed side by side.
    """
    x = rms + RMS_FLOOR
    logs = np.log(rms * rms + RMS_FLOOR)
    step = _even_step(q)
    if step is None or not len(count):
        terms = np.exp(np.multiply.outer(np.log(x), q))
        terms[:, q == 0.0] = logs[:, None]
        return run_sums(terms, count)
    if (count == count[0]).all() and count[0] > 0:
        x, logs = (np.ascontiguousarray(v.reshape(len(count), -1).T) for v in (x, logs))
        total = lambda v: v.sum(axis=0)
    else:
        at = np.cumsum(count) - count
        total = lambda v: np.add.reduceat(v, at)
    zero = int(np.flatnonzero(q == 0.0)[0])
    out = np.empty((len(q), len(count)))
    out[zero] = total(logs)
    with np.errstate(over="ignore", under="ignore"):
        up = np.exp(step * np.log(x))
        for factor, places in ((up, range(zero + 1, len(q))), (1.0 / up, range(zero - 1, -1, -1))):
            power = factor.copy()
            for k in places:
                out[k] = total(power)
                power *= factor
    return np.ascontiguousarray(out.T)


def roots(total: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """F from power sums over ``n`` segments each; nan where it is not positive and finite."""
    mean = total / n[:, None]
    with np.errstate(all="ignore"):
        f = np.exp(np.log(mean) / np.where(q == 0.0, 1.0, q))
        f[:, q == 0.0] = np.exp(0.5 * mean[:, q == 0.0])
    return np.where(np.isfinite(f) & (f > 0.0), f, np.nan)


def list_rows(batches: Iterator[pa.RecordBatch], column: str, keep: Sequence[str], out: str, width: int, run) -> Iterator[pa.RecordBatch]:
    """Turn the list of each row into ``width`` numbers by ``run(values, counts, first row, last row, batch)``.

    A step takes about STEP_VALUES list items, so it holds a bounded table of items by numbers.
    """
    for batch in batches:
        lists = batch.column(column)
        flat, at = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        at = at - at[0]
        begin = 0
        while begin < len(lists):
            end = int(np.searchsorted(at, at[begin] + STEP_VALUES, side="right")) - 1
            end = min(max(end, begin + 1), len(lists))
            made = run(flat.slice(at[begin], at[end] - at[begin]), np.diff(at[begin : end + 1]), batch.slice(begin, end - begin))
            known = pa.array(made.ravel(), mask=np.isnan(made.ravel()))
            offsets = pa.array(np.arange(0, made.size + 1, width, dtype=np.int32))
            kept = [batch.column(c).slice(begin, end - begin) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, known)], names=[*keep, out])
            begin = end


def fit(x: np.ndarray, f: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of ln F over x per run of ``count`` scales and per q, with the scales they rest on; nan where undefined."""
    known = np.isfinite(f)
    at = np.cumsum(count) - count
    enough = np.maximum.reduceat(known.sum(axis=1), at) >= MIN_Q
    known &= np.repeat(enough, count)[:, None]
    y = np.where(known, np.log(np.where(known, f, 1.0) + RMS_FLOOR), 0.0)
    x = np.where(known, x[:, None], 0.0)
    n, sx, sy, sxy, sxx = (run_sums(v, count) for v in (known.astype(float), x, y, x * y, x * x))
    h = (n * sxy - sx * sy) / (n * sxx - sx * sx + RIDGE)
    return n, np.where((n >= MIN_SCALES) & (h > 0.0), h, np.nan)


def slopes(h: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tau, alpha and f(alpha) of rows of h, as ``singularity`` has them."""
    tau = h * q - 1.0
    place = np.where(np.isnan(h), -1, np.arange(len(q)))
    before = np.maximum.accumulate(np.concatenate([np.full((len(h), 1), -1), place[:, :-1]], axis=1), axis=1)
    with np.errstate(all="ignore"):
        alpha = (tau - np.take_along_axis(tau, np.maximum(before, 0), axis=1)) / (q - q[np.maximum(before, 0)])
    alpha = np.where((before >= 0) & ~np.isnan(h), alpha, np.nan)
    return tau, alpha, q * alpha - tau
