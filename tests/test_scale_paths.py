"""The plans for long series give the same result as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalefold.operators import channels as ch
from scalefold.operators import cleaning as cl
from scalefold.operators import coherence as co
from scalefold.operators import indexing as ix
from scalefold.operators import recursive as rc
from scalefold.operators import smoothing as sm
from scalefold.operators import wavelet as wv
from scalefold.operators.grids import Q_GRID
from tests.conftest import by_series

SERIES = ("series_id",)


def test_ranged_index_equals_window(spark, samples):
    shuffled = samples.withColumnRenamed("idx", "at")
    a = ix.dense_index(shuffled, SERIES, ["at"])
    b = ix.dense_index(shuffled, SERIES, ["at"], task_rows=0)
    assert a.filter("idx <> at").count() == 0
    assert b.filter("idx <> at").count() == 0
    assert b.count() == samples.count()


def test_ranged_index_spreads_one_series(spark):
    df = spark.range(200_000).select(F.lit("one").alias("series_id"), (F.col("id") * 7919 % 200_000).alias("at"))
    got = ix.dense_index(df, SERIES, ["at"], task_rows=0)
    assert got.filter("idx <> at").count() == 0
    assert got.select(F.count_distinct("at")).first()[0] == 200_000


def test_ranged_quantiles(spark, samples):
    heavy = samples.withColumn("value", F.when(F.col("idx") % 3 == 0, 0.5).otherwise(F.col("value")))
    probs = [0.0, 0.025, 0.5, 0.975, 1.0]
    a = {r[0]: r[1:] for r in ix.quantiles(heavy, SERIES, probs).collect()}
    b = {r[0]: r[1:] for r in ix.quantiles(heavy, SERIES, probs, task_rows=0).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-12)


def test_ranged_cleaning(spark, samples):
    for op in (cl.quantile_trim, cl.winsorize, cl.median_impute):
        a, b = by_series(op(samples, SERIES)), by_series(op(samples, SERIES, task_rows=0))
        assert a.keys() == b.keys()
        for k in a:
            np.testing.assert_allclose(a[k], b[k], rtol=1e-12)


@pytest.mark.parametrize("smooth", [lambda d, b: sm.smooth_mean(d, SERIES, 7, b), lambda d, b: sm.smooth_quadratic(d, SERIES, b)])
def test_smoothing_in_blocks(spark, samples, monkeypatch, smooth):
    whole = by_series(smooth(samples, True))
    monkeypatch.setattr(sm, "BLOCK", 64)
    parts = by_series(smooth(samples, False))
    for k in whole:
        np.testing.assert_allclose(parts[k], whole[k], rtol=1e-9, atol=1e-9)


def test_smoothing_keeps_a_constant(spark):
    df = spark.range(100).select(F.lit("c").alias("series_id"), F.col("id").alias("idx"), F.lit(2.5).alias("value"))
    for out in (sm.smooth_mean(df, SERIES, 5), sm.smooth_quadratic(df, SERIES)):
        assert np.allclose(by_series(out)["c"], 2.5)


def test_smoothing_short_series(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(3)], "series_id string, idx bigint, value double")
    padded = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2], dtype=float)
    want = [padded[i : i + 7].mean() for i in range(3)]
    assert np.allclose(by_series(sm.smooth_mean(df, SERIES, 7))["s"], want)


@pytest.mark.parametrize("n", [30, 60, 125, 250, 251])
def test_wavelet_inverse(n):
    x = np.random.default_rng(n).normal(size=n)
    approx, details = wv.decompose(x, 5 if n > 100 else 4)
    out = approx
    for d in reversed(details):
        out = wv.join_once(out, d)
    np.testing.assert_allclose(out[:n], x, atol=1e-10)


def test_wavelet_level_lengths():
    lengths = [len(d) for d in wv.decompose(np.zeros(250), 5)[1]]
    assert lengths == [128, 67, 37, 22, 14]


@pytest.mark.parametrize("level", [4, 5])
def test_wavelet_in_blocks(spark, samples, noise, monkeypatch, level):
    monkeypatch.setattr(wv, "BLOCK", 1024)
    got = by_series(wv.shrink(samples, SERIES, level))
    for name, x in noise.items():
        limit = np.std(wv.split_once(x)[1]) * np.sqrt(2 * np.log(len(x)))
        np.testing.assert_allclose(got[name], wv._shrunk(x, level, limit), rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("bounded", [False, True])
def test_shrunk_blocks_leave_a_task_in_bounded_steps(spark, samples, monkeypatch, bounded):
    """Blocks go through Python as lists of Arrow, not as tables of objects; small steps give the same rows, undefined series too."""
    odd = samples.withColumn("value", F.expr("if(series_id = 'short' and idx = 7, null, value)")).filter("series_id <> 'long' or idx < 900")
    whole = by_series(wv.shrink(odd, SERIES, 4, bounded))
    monkeypatch.setattr(wv, "STEP_VALUES", 100)
    out = wv.shrink(odd, SERIES, 4, bounded)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert by_series(out) == whole and set(whole["short"]) == {None} and None not in whole["long"] + whole["walk"]


def test_wavelet_bounded_equals_blocks(spark, samples):
    a = by_series(wv.shrink(samples, SERIES, 4, bounded=True))
    b = by_series(wv.shrink(samples, SERIES, 4))
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-8, atol=1e-9)


def test_analysis_rows_equal_arrays(spark, samples, noise):
    rows = wv.analyse(samples, SERIES).cache()
    approx, detail = by_series(rows, "k", "approx"), by_series(rows, "k", "detail")
    for name, x in noise.items():
        a, d = wv.split_once(x)
        np.testing.assert_allclose(approx[name], a, atol=1e-9)
        np.testing.assert_allclose(detail[name], d, atol=1e-9)


def direct_filter(x, sections):
    for b0, b1, b2, a0, a1, a2 in sections:
        y, z1, z2 = np.empty(len(x)), 0.0, 0.0
        for i, v in enumerate(x):
            y[i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[i] + z2, b2 * v - a2 * y[i]
        x = y
    return x


@pytest.mark.parametrize("chunk", [512, 16_384])
def test_bandpass_in_chunks(spark, samples, noise, chunk):
    got = by_series(rc.bandpass(samples, SERIES, chunk=chunk))
    for name, x in noise.items():
        want = direct_filter(x, rc.STRAIN_SECTIONS)
        np.testing.assert_allclose(got[name], want, rtol=1e-7, atol=1e-9 * np.abs(want).max())


def test_bandpass_refuses_unstable(spark, samples):
    with pytest.raises(ValueError):
        rc.bandpass(samples, SERIES, [[1.0, 0.0, 0.0, 1.0, -2.5, 1.2]])


@pytest.mark.parametrize("most", [100, 999, 1000, 3001])
def test_downsample_positions(spark, samples, noise, most):
    got = by_series(ch.downsample(samples, SERIES, most))
    for name, x in noise.items():
        want = x if len(x) <= most else x[np.linspace(0, len(x) - 1, most, dtype=int)]
        np.testing.assert_array_equal(got[name], want)


def _packed(spark, n, gaps):
    rng = np.random.default_rng(n)
    spectra = rng.normal(size=(n, len(Q_GRID)))
    if gaps:
        spectra[rng.random(spectra.shape) < 0.2] = np.nan
    rows = [(f"s{i:03d}", k, None if np.isnan(h) else float(h)) for i, s in enumerate(spectra) for k, h in enumerate(s)]
    return spectra, co.pack(spark.createDataFrame(rows, "series_id string, q_pos int, h double"))


@pytest.mark.parametrize("gaps", [False, True])
def test_pairs_in_blocks(spark, gaps):
    spectra, packed = _packed(spark, 23, gaps)
    got = {(r["ds_a"], r["ds_b"]): (r["n_q"], r["abs_corr"]) for r in co.pair_correlations(packed, "TCI", block=5).collect()}
    assert len(got) == 23 * 22 // 2
    for (a, b), (n, r) in got.items():
        x, y = spectra[int(a[1:])], spectra[int(b[1:])]
        ok = np.isfinite(x) & np.isfinite(y)
        assert n == ok.sum()
        assert r == pytest.approx(abs(np.corrcoef(x[ok], y[ok])[0, 1]), abs=1e-10)
    mean = np.mean([r for _, r in got.values()])
    for block in (4, 100):
        assert co.mean_coherence(packed, "tci", block=block).first()["tci"] == pytest.approx(mean, abs=1e-10)


def test_sliced_sums_of_powers(spark, noise):
    """Welch: the whole one-sided power is about the variance."""
    from scalefold.operators.power import welch

    df = spark.createDataFrame(
        [("w", i, float(v)) for i, v in enumerate(noise["long"])], "series_id string, idx bigint, value double"
    )
    rows = welch(df, SERIES).collect()
    nps = rows[0]["nps"]
    assert nps == 1024 and len(rows) == 513
    assert sum(r["power"] for r in rows) / nps == pytest.approx(noise["long"].var(), rel=0.1)


def test_short_tables_of_the_ranged_plan_are_not_joined_by_a_shuffle(spark):
    """What is joined to all rows is read from a file of known size, so it is broadcast where they are not."""
    rows = spark.range(40_000).selectExpr("cast(id % 2 as string) as series_id", "id as idx", "rand(1) as value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        for df in (ix.dense_index(rows, SERIES, ["value", "idx"], "at", task_rows=10), cl.quantile_trim(rows, SERIES, task_rows=10)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
