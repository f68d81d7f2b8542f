"""The fluctuation analysis against a plain numpy reading of its contract, and its properties."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalefold.operators import arrays as ar
from scalefold.operators import fluctuation as fl
from scalefold.operators.grids import Q_GRID, lines_scales, log_scales, whole_scales
from tests.conftest import by_series

SERIES = ("series_id",)
SCALES = [4, 8, 8, 16, 33, 64, 128, 4000]


def numpy_spectrum(x, scales, detrend=0):
    """h and D_f of one array."""
    q = np.array(Q_GRID)
    table = np.full((len(scales), len(q)), np.nan)
    for row, s in zip(table, scales):
        cut = np.reshape(x[: len(x) // s * s], (-1, s)) if len(x) >= s else np.empty((0, s))
        keep = cut.std(axis=1) >= 1e-10 if len(cut) else np.zeros(0, dtype=bool)
        if len(cut) < 2 or keep.sum() < 2:
            continue
        cut = cut[keep]
        trend = cut.mean(axis=1, keepdims=True)
        if detrend:
            t = np.arange(s)
            denominator = s * (t * t).sum() - t.sum() ** 2 + 1e-5
            m = (s * cut @ t - t.sum() * cut.sum(axis=1)) / denominator
            b = (cut.sum(axis=1) * (t * t).sum() - t.sum() * (cut @ t)) / denominator
            trend = m[:, None] * t + b[:, None]
        rms = np.sqrt(((cut - trend) ** 2).mean(axis=1) + 1e-12)
        for j, qj in enumerate(q):
            row[j] = (
                np.exp(0.5 * np.log(rms**2 + 1e-12).mean()) if qj == 0 else ((rms + 1e-12) ** qj).mean() ** (1 / qj)
            )
    h = np.full(len(q), np.nan)
    if np.isfinite(table).sum(axis=1).max() >= 4:
        for j in range(len(q)):
            ok = np.isfinite(table[:, j]) & (table[:, j] > 0)
            if ok.sum() >= 4:
                lx, ly = np.log(np.array(scales)[ok]), np.log(table[ok, j] + 1e-12)
                n = ok.sum()
                slope = (n * (lx * ly).sum() - lx.sum() * ly.sum()) / (n * (lx * lx).sum() - lx.sum() ** 2 + 1e-5)
                h[j] = slope if slope > 0 else np.nan
    ok = np.isfinite(h)
    d_f = np.mean(np.diff(h[ok] * q[ok] - 1) / np.diff(q[ok])) if ok.sum() >= 2 else np.nan
    return h, d_f


@pytest.mark.parametrize("detrend", [0, 1])
def test_matches_numpy(spark, samples, noise, detrend):
    spec = fl.measure(samples, SERIES, SCALES, detrend).cache()
    got = by_series(spec, "q_pos", "h")
    d_f = {r["series_id"]: r["d_f"] for r in fl.dimension(spec, SERIES).collect()}
    for name, values in noise.items():
        h, want = numpy_spectrum(values, SCALES, detrend)
        mine = np.array([np.nan if v is None else v for v in got.get(name, [None] * 81)])
        np.testing.assert_allclose(mine, h, rtol=1e-8, atol=1e-10)
        if np.isfinite(want):
            assert d_f[name] == pytest.approx(want, rel=1e-8)


def test_grid_per_series_equals_fixed_grid(spark, samples):
    fixed = fl.measure(samples, SERIES, SCALES)
    per_row = fl.measure(samples.withColumn("scales", F.lit(SCALES)), SERIES)
    assert sorted(fixed.select("series_id", "q_pos", F.round("h", 9)).collect()) == sorted(
        per_row.select("series_id", "q_pos", F.round("h", 9)).collect()
    )


def test_scale_invariance(spark, samples):
    big = fl.measure(samples.withColumn("value", F.col("value") * 1e4), SERIES, SCALES)
    base = fl.measure(samples, SERIES, SCALES)
    joined = big.select("series_id", "q_pos", F.col("h").alias("b")).join(base, ["series_id", "q_pos"])
    worst = joined.select(F.max(F.abs(F.col("b") - F.col("h")))).first()[0]
    assert worst < 1e-6


def test_dimension_is_the_mean_of_the_end_slopes(spark, samples):
    rows = fl.measure(samples.filter("series_id = 'walk'"), SERIES, SCALES)
    h = by_series(rows, "q_pos", "h")["walk"]
    d_f = fl.dimension(rows, SERIES).first()["d_f"]
    assert None not in h
    assert d_f == pytest.approx((h[0] + h[-1]) / 2, abs=1e-9)


def test_fluctuation_grows_with_q(spark, samples):
    rows = fl.fluctuation(samples, SERIES, SCALES).collect()
    curves = {}
    for r in rows:
        curves.setdefault((r["series_id"], r["scale_pos"]), []).append((r["q_pos"], r["f"]))
    for points in curves.values():
        f = np.array([v for k, v in sorted(points) if k != 40])
        assert (np.diff(f) >= -1e-9 * f[:-1]).all()


def test_constant_and_tiny_series_have_no_spectrum(spark):
    rows = [("flat", i, 1.0) for i in range(500)] + [("tiny", i, float(i % 3)) for i in range(7)]
    df = spark.createDataFrame(rows, "series_id string, idx bigint, value double")
    assert fl.measure(df, SERIES, SCALES).count() == 0


def test_three_scales_are_not_enough(spark, samples):
    spec = fl.measure(samples, SERIES, [4, 8, 16])
    assert spec.count() == 3 * 81 and spec.filter("h is not null").count() == 0


def test_reliability(spark):
    def rows(name, h):
        return [(name, k, q, v) for (k, q), v in zip(enumerate(Q_GRID), h)]

    falling = [2.0 - 0.1 * k / 81 for k in range(81)]
    rising = [1.0 + 0.1 * k for k in range(81)]
    gappy = [1.0 if k < 40 else None for k in range(81)]
    df = spark.createDataFrame(
        rows("falling", falling) + rows("rising", rising) + rows("gappy", gappy),
        "series_id string, q_pos int, q double, h double",
    )
    got = {r["series_id"]: r["is_valid"] for r in fl.reliable(df, SERIES).collect()}
    assert got == {"falling": True, "rising": False, "gappy": False}
    free = {r["series_id"]: r["is_valid"] for r in fl.reliable(df, SERIES, monotone=False).collect()}
    assert free == {"falling": True, "rising": True, "gappy": False}


def test_gap_is_bridged_by_neighbouring_valid_q(spark):
    h = [1.0, None, 0.8, 0.7]
    df = spark.createDataFrame(
        [("a", 1, k, float(k), v) for k, v in enumerate(h)],
        "series_id string, n_scales int, q_pos int, q double, h double",
    )
    got = [r["alpha"] for r in fl.singularity(df, SERIES).orderBy("q_pos").collect()]
    assert got[0] is None and got[1] is None
    assert got[2] == pytest.approx((0.8 * 2 - 1 - (1.0 * 0 - 1)) / 2)
    assert got[3] == pytest.approx((0.7 * 3 - 1) - (0.8 * 2 - 1))


def test_grids():
    assert len(Q_GRID) == 81 and Q_GRID[0] == -8.0 and Q_GRID[40] == 0.0 and Q_GRID[-1] == 8.0
    strain = log_scales(8, 4096, 20)
    assert (strain[0], strain[-1], len(strain)) == (7, 4095, 20)
    assert lines_scales(4000)[-1] == 499 and len(lines_scales(300)) == 15
    assert whole_scales(6144)[0] == 7 and min(whole_scales(60)) > 4


@pytest.mark.parametrize("counts", [[64] * 256, [3, 1, 700, 2, 5000, 9]])
def test_power_sums_make_no_table_of_segments_by_q(counts):
    """Equal to the definition over twelve decades, and in room for a few values a segment."""
    q, count = np.array(Q_GRID), np.array(counts)
    rms = np.exp(np.random.default_rng(3).uniform(-14, 14, count.sum()))
    x = rms + ar.RMS_FLOOR
    terms = np.where(q == 0.0, np.log(rms * rms + ar.RMS_FLOOR)[:, None], x[:, None] ** np.where(q == 0.0, 1.0, q))
    want = np.stack([part.sum(axis=0) for part in np.split(terms, np.cumsum(count)[:-1])])
    tracemalloc.start()
    got = ar.power_sums(rms, count, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert peak < 12 * 8 * count.sum() + 4 * got.nbytes


def test_power_sums_of_other_grids():
    for grid in ([-1.0, 0.0, 2.0], [1.0, 2.0, 3.0], [0.0]):
        got = ar.power_sums(np.array([1.0, 2.0, 4.0]), np.array([2, 1]), np.array(grid))
        want = [[2 * np.log(2.0) if p == 0 else 1.0 + 2.0**p for p in grid], [2 * np.log(4.0) if p == 0 else 4.0**p for p in grid]]
        np.testing.assert_allclose(got, want, rtol=1e-9)
