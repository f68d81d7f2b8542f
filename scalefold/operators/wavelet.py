"""Wavelet decomposition and shrinkage.

``analyse`` is one level of the filter bank as a group-by. ``shrink`` runs all
levels: each series is cut into blocks with a halo wide enough that the
samples a block owns come out the same as from the whole series, so blocks of
one long series are worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.operators.arrays import kinds
from scalefold.operators.indexing import Keys, lengths, with_halo

# The eight-tap low-pass decomposition filter with four vanishing moments.
LOW = [
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
]
TAPS = len(LOW)
HIGH = [(-1) ** (j + 1) * LOW[TAPS - 1 - j] for j in range(TAPS)]

BLOCK = 16_384
# Both are multiples of 2 ** MAX_LEVEL, so blocks start on the grid of every level.
HALO = 512
MAX_LEVEL = 5

#: Shrunk values that leave a task in one batch.
STEP_VALUES = 1 << 17


def analyse(df: DataFrame, keys: Keys) -> DataFrame:
    """D3. One decomposition level: ``(keys, k, approx, detail)``, k in [0, (n + 7) div 2).

    Every sample adds to at most four coefficients, near the ends also through
    its mirror images; sums are combined before the shuffle.
    """
    n, i = F.col("_n"), F.col("idx")
    top = 2 * F.expr(f"(_n + {TAPS - 1}) div 2") - 1
    mirrored = F.flatten(
        F.transform(F.sequence(F.lit(-TAPS), F.lit(TAPS)), lambda t: F.array(i + 2 * n * t, 2 * n * t - 1 - i))
    )
    places = F.when((i >= TAPS) & (i < n - TAPS), F.array(i)).otherwise(
        F.filter(mirrored, lambda e: (e >= 2 - TAPS) & (e <= top))
    )
    bank = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for j, (a, b) in enumerate(zip(LOW, HIGH))])
    return (
        df.join(lengths(df, keys, "_n"), list(keys))
        .select(*keys, "value", "_n", F.explode(places).alias("_e"))
        .select(*keys, "value", "_n", "_e", F.inline(bank))
        .withColumn("_k2", F.col("_e") + F.col("j") - 1)
        .filter((F.col("_k2") % 2 == 0) & F.col("_k2").between(0, 2 * F.expr(f"(_n + {TAPS - 1}) div 2") - 2))
        .groupBy(*keys, F.expr("_k2 div 2").alias("k"))
        .agg(
            F.sum(F.col("value") * F.col("lo")).alias("approx"),
            F.sum(F.col("value") * F.col("hi")).alias("detail"),
        )
    )


def split_once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One decomposition level of an array, mirrored at both ends."""
    padded = np.pad(x, TAPS - 1, mode="symmetric")
    return np.convolve(padded, LOW, "valid")[1::2], np.convolve(padded, HIGH, "valid")[1::2]


def join_once(approx: np.ndarray, detail: np.ndarray) -> np.ndarray:
    """Inverse of ``split_once``."""
    size = 2 * len(detail)
    up = np.zeros((2, size))
    up[0, ::2], up[1, ::2] = approx[: len(detail)], detail
    whole = np.convolve(up[0], LOW[::-1]) + np.convolve(up[1], HIGH[::-1])
    return whole[TAPS - 2 : size]


def decompose(x: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    details = []
    for _ in range(level):
        x, d = split_once(x)
        details.append(d)
    return x, details


def _shrunk(x: np.ndarray, level: int, t: float) -> np.ndarray:
    approx, details = decompose(x, level)

    def soft(c: np.ndarray) -> np.ndarray:
        return np.sign(c) * np.maximum(np.abs(c) - t, 0.0)

    out = soft(approx)
    for d in reversed(details):
        out = join_once(out, soft(d))
    return out[: len(x)]


def _blocks(df: DataFrame, keys: Keys) -> DataFrame:
    """One row per block: its samples in order, where they start and which of them it owns."""
    return (
        with_halo(df, BLOCK, HALO)
        .groupBy(*keys, "_block")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("x"),
            F.min("idx").alias("lo"),
            F.min(F.when(F.col("_own"), F.col("idx"))).alias("own"),
            F.count_if("_own").cast("int").alias("n_own"),
            F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_null"),
        )
        .filter(F.col("n_own") > 0)
    )


def _values(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int]]:
    """(samples, those ahead of its own, its own) of each block, one at a time; nan for NULL."""
    ahead = pc.subtract(batch.column("own"), batch.column("lo")).to_pylist()
    for k, (a, m) in enumerate(zip(ahead, batch.column("n_own").to_pylist())):
        yield np.asarray(batch.column("x")[k].values.to_numpy(zero_copy_only=False), dtype=float), a, m


def _detail_sums(blocks: DataFrame, keys: Keys) -> DataFrame:
    """Count, sum and sum of squares of the finest details a block owns, with ``n_own`` and ``n_null``."""
    kept = [*keys, "n_own", "n_null"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values, ahead, m in _values(batch):
                d = split_once(values)[1]
                start = ahead // 2
                stop = len(d) if ahead + m == len(values) else start + m // 2
                d = d[start:stop]
                rows.append((len(d), d.sum(), (d * d).sum()))
            n, s, ss = (np.array(c, dtype=float) for c in zip(*rows)) if rows else [np.zeros(0)] * 3
            sums = [pa.array(n.astype(np.int64)), *(pa.array(c, mask=np.isnan(c)) for c in (s, ss))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "m", "s", "ss"])

    rows = blocks.select(*kept, "lo", "own", "x")
    return rows.mapInArrow(run, kinds(rows, *kept) + "m long, s double, ss double")


def _shrunk_blocks(sized: DataFrame, keys: Keys, level: int, bounded: bool) -> DataFrame:
    """The samples each block owns, shrunk, as ``_y``. What a task holds beside the batch it was given is bounded in values, not in blocks."""
    kept = [*keys, "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = batch.column("t").to_pylist()
            made: list[np.ndarray] = []
            begin = size = 0

            def rows() -> pa.RecordBatch:
                flat = np.concatenate(made)
                offsets = pa.array(np.append(0, np.cumsum([len(y) for y in made])).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
                own = [batch.column(c).slice(begin, len(made)) for c in kept]
                return pa.RecordBatch.from_arrays([*own, lists], names=[*kept, "_y"])

            for values, ahead, m in _values(batch):
                limit = limits[begin + len(made)]
                limit = np.nan if limit is None else limit
                if bounded and not np.isnan(values).any():
                    limit = np.std(split_once(values)[1]) * np.sqrt(2.0 * np.log(len(values)))
                made.append(np.full(m, np.nan) if np.isnan(limit) else _shrunk(values, level, limit)[ahead : ahead + m])
                size += m
                if size >= STEP_VALUES:
                    yield rows()
                    begin, size, made = begin + len(made), 0, []
            if made:
                yield rows()

    rows = sized.select(*kept, "lo", "n_own", "t", "x")
    return rows.mapInArrow(run, kinds(rows, *kept) + "_y array<double>")


def shrink(df: DataFrame, keys: Keys, level: int, bounded: bool = False) -> DataFrame:
    """D3-D5. Soft-threshold every coefficient by std(finest details) * sqrt(2 ln n), then rebuild.

    ``bounded`` series fit one block, which then finds the threshold itself;
    otherwise it is put together from partial sums of all blocks. A series
    with an undefined value has no threshold and comes out NULL throughout.
    """
    if not 1 <= level <= MAX_LEVEL:
        raise ValueError(f"level must be 1 to {MAX_LEVEL}")
    blocks = _blocks(df, keys)
    if bounded:
        sized = blocks.withColumn("t", F.lit(None).cast("double"))
    else:
        total = _detail_sums(blocks, keys).groupBy(*keys).agg(
            F.sum("n_own").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.sum("n_null").alias("n_null"),
        )
        spread = F.sqrt(F.greatest(F.expr("ss / m - (s / m) * (s / m)"), F.lit(0.0)))
        sized = blocks.join(
            total.select(
                *keys, F.when(F.col("n_null") == 0, spread * F.sqrt(2.0 * F.ln(F.col("n").cast("double")))).alias("t")
            ),
            list(keys),
        )
    return (
        _shrunk_blocks(sized, keys, level, bounded)
        .select(*keys, "own", F.posexplode("_y").alias("_at", "value"))
        .select(*keys, (F.col("own") + F.col("_at")).alias("idx"), "value")
    )
