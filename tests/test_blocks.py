"""Blocks and packed windows give what whole series and denoised rows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalefold.config import Family, family_config
from scalefold.operators import fluctuation as fl
from scalefold.operators import packed as pk
from scalefold.operators import sampling as sa
from scalefold.plans import run as rn
from tests.conftest import by_series

SERIES = ("series_id",)
SCALES = [1, 2, 4, 8, 8, 16, 33, 64, 128, 700, 4000]


def plain_segments(x, scales, detrend=0, profile=False, bidirectional=False):
    """{(scale_pos, seg): rms} of one array, nan for NULL."""
    if profile:
        x = np.where(np.isfinite(x), np.nancumsum(x - np.nanmean(x)), np.nan)
    out = {}
    for pos, s in enumerate(scales):
        many = len(x) // s
        cuts = [(k, x[k * s : k * s + s]) for k in range(many)]
        if bidirectional:
            cuts += [(-k, x[len(x) - k * s : len(x) - k * s + s]) for k in range(1, many + 1)]
        for seg, v in cuts:
            if not np.isfinite(v).all() or v.std() < 1e-10:
                continue
            t = np.arange(s) - (s - 1) / 2
            rest = v - v.mean()
            if detrend:
                squares = s * (t * t).sum() + 1e-5
                rest = rest - s * (rest @ t) / squares * t + v.mean() * 1e-5 / squares
            out[pos, seg] = np.sqrt((rest * rest).mean() + 1e-12)
    return out


@pytest.mark.parametrize("block", [50, 96, 32_768])
@pytest.mark.parametrize("detrend, profile, bidirectional", [(0, False, False), (1, False, False), (1, True, False), (0, True, True), (1, False, True)])
def test_segments_of_blocks(spark, samples, noise, block, detrend, profile, bidirectional):
    gaps = F.when(F.col("idx") % 701 == 50, None).otherwise(F.col("value"))
    got = {}
    for r in fl.segment_rms(samples.withColumn("value", gaps), SERIES, SCALES, detrend, profile, bidirectional, block=block).collect():
        got.setdefault(r.series_id, {})[r.scale_pos, r.seg] = r.rms
    for name, x in noise.items():
        want = plain_segments(np.where(np.arange(len(x)) % 701 == 50, np.nan, x), SCALES, detrend, profile, bidirectional)
        assert got[name].keys() == want.keys()
        for k in want:
            assert got[name][k] == pytest.approx(want[k], rel=1e-9)


@pytest.mark.parametrize("block", [50, 32_768])
def test_straight_segments_keep_their_digits(spark, block):
    """A steep line with a tiny rest, cut into parts or not."""
    rng = np.random.default_rng(5)
    x = 1e6 + 3.0 * np.arange(3000) + 1e-4 * rng.normal(size=3000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx bigint, value double")
    want = plain_segments(x, [8, 64, 300], 1)
    for r in fl.segment_rms(df, SERIES, [8, 64, 300], 1, block=block).collect():
        assert r.rms == pytest.approx(want[r.scale_pos, r.seg], rel=1e-4)


@pytest.mark.parametrize("profile, bidirectional", [(False, False), (True, True)])
def test_spectra_of_blocks(spark, samples, profile, bidirectional):
    spectra = [
        by_series(fl.measure(samples, SERIES, SCALES[:8], profile=profile, bidirectional=bidirectional, block=block), "q_pos", "h")
        for block in (50, 32_768)
    ]
    assert spectra[0].keys() == spectra[1].keys() == {"long", "walk", "short"}
    for name in spectra[0]:
        np.testing.assert_allclose(np.array(spectra[0][name], float), np.array(spectra[1][name], float), rtol=1e-8)


def test_grids_of_their_own(spark, samples):
    grids = spark.createDataFrame([("long", [4, 8, 16, 32, 64]), ("walk", [8, 16, 32, 64, 128]), ("none", [4])], "series_id string, scales array<int>")
    got = by_series(fl.measure(samples, SERIES, grids=grids, block=100), "q_pos", "h")
    for name, scales in (("long", [4, 8, 16, 32, 64]), ("walk", [8, 16, 32, 64, 128])):
        alone = by_series(fl.measure(samples.filter(F.col("series_id") == name), SERIES, scales), "q_pos", "h")
        np.testing.assert_allclose(np.array(got[name], float), np.array(alone[name], float), rtol=1e-9)
    assert got.keys() == {"long", "walk"}


@pytest.mark.parametrize("recipe", ["unit_std", "z_score", "strain"])
@pytest.mark.parametrize("block", [1, 8192])
def test_packed_windows_equal_denoised_rows(spark, samples, monkeypatch, recipe, block):
    monkeypatch.setattr(pk, "BLOCK", block)
    monkeypatch.setattr(pk, "BLOCK_WINDOWS", 1)
    monkeypatch.setattr(pk, "STEP_VALUES", 700)
    family = Family("f", 250, 12, 1.19, 0.04, recipe, [2, 4, 8, 16, 32, 64, 128, 200])
    gaps = F.when(F.col("idx") % 401 == 7, None).otherwise(F.col("value"))
    tagged = samples.withColumn("family", F.lit("f")).withColumn("value", gaps)
    plan = sa.subset_plan(rn.series_lengths(tagged), family_config(spark, [family]))
    windows = sa.subset_windows(plan).cache()
    direct = rn.measure_subsets(tagged, windows, plan, [family])
    rows = pk.measure_rows(rn.subset_rows(tagged, windows, [family]), rn.window_scales(windows, plan, [family]))
    a, b = ({(r.series_id, r.subset_id): r for r in df.collect()} for df in (direct, rows))
    assert a.keys() == b.keys() and len(a) > 80
    for k in a:
        assert a[k].n_segments == b[k].n_segments and a[k].n_valid_q == b[k].n_valid_q
        for name in ("d_f", "mean_h"):
            assert (a[k][name] is None) == (b[k][name] is None)
            assert a[k][name] is None or a[k][name] == pytest.approx(b[k][name], rel=1e-7)


def test_written_windows_are_measured_without_a_shuffle(spark, samples, tmp_path):
    family = Family("f", 250, 12, 1.19, 0.04, "z_score", [2, 4, 8, 16, 32])
    tagged = samples.withColumn("family", F.lit("f"))
    plan = sa.subset_plan(rn.series_lengths(tagged), family_config(spark, [family]))
    windows = sa.subset_windows(plan).cache()
    clean = rn.subset_rows(tagged, windows, [family]).withColumn("value", F.when(F.col("idx") % 50 != 3, F.col("value")))
    pk.pack_rows(clean, rn.window_scales(windows, plan, [family])).write.parquet(str(tmp_path / "k12"))
    written = spark.read.parquet(str(tmp_path / "k12"))
    assert written.count() == written.select("series_id", "subset_id").distinct().count() > 80
    columns = ["series_id", "subset_id", "family", "size", "idx", "value"]
    got, want = (df.select(*columns).withColumn("value", F.round("value", 9)) for df in (pk.unpacked(written), clean))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    measures = pk.measure_packed(written)
    assert "Exchange" not in measures._jdf.queryExecution().executedPlan().toString()
    assert measures.count() == written.count()


def test_packed_windows_without_all_rows(spark):
    """Missing ends give nothing, a gap is undefined, rows beyond the size do not count."""
    schema = "series_id string, subset_id int, family string, size int, scales array<int>, idx array<bigint>, value array<double>"
    whole = [float(i * 7 % 17) for i in range(16)]
    rows = [
        ("whole", 0, "f", 16, [2, 4, 8], list(range(16)), whole),
        ("longer", 0, "f", 16, [2, 4, 8], list(range(18)), [*whole, 1.0, 2.0]),
        ("no start", 0, "f", 16, [2, 4, 8], list(range(1, 16)), whole[1:]),
        ("no end", 0, "f", 16, [2, 4, 8], list(range(15)), whole[:-1]),
        ("gap", 0, "f", 16, [2, 4, 8], [i for i in range(16) if i != 5], whole[:5] + whole[6:]),
        ("null", 0, "f", 16, [2, 4, 8], list(range(16)), [*whole[:5], None, *whole[6:]]),
        ("empty", 0, "f", 16, [2, 4, 8], [], []),
        (None, 0, "f", 16, [2, 4, 8], list(range(16)), whole),
    ]
    got = {r.series_id: r for r in pk.measure_packed(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == {"whole", "longer", "gap", "null", None}
    assert got["whole"].f == got["longer"].f == got[None].f and got["gap"].f == got["null"].f != got["whole"].f
    assert got["whole"].n_segments == [8, 4, 2] and got["gap"].n_segments == [7, 3, 1]


def test_one_window_against_the_whole_series_plan(spark, samples, noise):
    """A window measured in its array is a short series measured by blocks."""
    x = noise["walk"][100:350] / noise["walk"][100:350].std()
    df = spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(x)], "series_id string, idx bigint, value double")
    scales = [2, 4, 8, 16, 32, 64]
    want = by_series(fl.measure(df, SERIES, scales), "q_pos", "h")["w"]
    windows = spark.createDataFrame([("walk", 0, 100, 250, "unit_std", scales)], "series_id string, subset_id int, start bigint, size int, recipe string, scales array<int>")
    measures = pk.measure_windows(samples, windows, 250)
    got = by_series(pk.spectrum_rows(measures), "q_pos", "h")["walk"]
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), rtol=1e-9)
    f = {r.scale_pos: (r.s, r.n_segments, r.f) for r in pk.fluctuation_rows(measures).collect()}
    for r in fl.fluctuation_rows(df, SERIES, scales).collect():
        assert f[r.scale_pos][:2] == (r.s, r.n_segments)
        np.testing.assert_allclose(f[r.scale_pos][2], r.f, rtol=1e-9)


def test_samples_are_shuffled_once(spark, samples):
    family = Family("f", 250, 12, 1.19, 0.04, "unit_std", [2, 4, 8, 16])
    windows = spark.createDataFrame([("walk", 0, 100, 250, "unit_std", [2, 4])], "series_id string, subset_id int, start bigint, size int, recipe string, scales array<int>")
    plan = pk.measure_windows(samples, windows, family.subset_size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_subsets_are_packed_where_the_samples_lie(spark, samples):
    """The same rows as those cut and denoised one by one, with one shuffle."""
    family = Family("f", 250, 12, 1.19, 0.04, "unit_std", [2, 4, 8, 16])
    tagged = samples.withColumn("family", F.lit("f"))
    plan = sa.subset_plan(rn.series_lengths(tagged), family_config(spark, [family]))
    windows = sa.subset_windows(plan)
    rows = pk.pack_rows(rn.subset_rows(tagged, windows, [family]), rn.window_scales(windows, plan, [family]))
    direct = rn.pack_subsets(tagged, windows, plan, [family])
    assert direct.columns == rows.columns

    def table(df):
        rows = [(r.series_id, r.subset_id, r.family, r.size, r.scales, r.idx, [v if v is None else round(v, 9) for v in r.value]) for r in df.collect()]
        return sorted(rows, key=lambda r: r[:2])

    assert table(direct) == table(rows)
    own = spark.createDataFrame([("walk", 0, "f", 100, 250, "unit_std", [2, 4])], "series_id string, subset_id int, family string, start bigint, size int, recipe string, scales array<int>")
    assert pk.pack_windows(samples, own, 250)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_only_columns_asked_for_leave_the_step(spark, samples):
    windows = spark.createDataFrame([("walk", 0, 100, 250, "", [2, 4, 8, 16])], "series_id string, subset_id int, start bigint, size int, recipe string, scales array<int>")
    whole = pk.measure_windows(samples, windows, 250)
    few = pk.measure_windows(samples, windows, 250, columns=["h", *pk.SUMMARY])
    assert few.columns == [*pk.WINDOW, "h", *pk.SUMMARY]
    assert few.select(*pk.SUMMARY).collect() == whole.select(*pk.SUMMARY).collect()
    columns = ["q_pos", "q", "h"]
    assert pk.spectrum_rows(few).select(columns).collect() == pk.spectrum_rows(whole).select(columns).collect()
