"""Policy, folds, summaries and the whole run."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalefold.config import Family, family_config
from scalefold.operators import coherence as co
from scalefold.operators import export as ex
from scalefold.operators import sampling as sa
from scalefold.operators import summary as su
from scalefold.operators.denoise import denoise
from scalefold.operators.grids import Q_GRID
from scalefold.plans import run as rn
from scalefold.plans.registry import SCALES
from tests.conftest import by_series

FAMILY = Family("ledger", 250, 20, 1.19, 0.04, "unit_std", SCALES)


def test_policy_boundaries(spark):
    rows = [("a", "catalog", 9), ("b", "catalog", 10), ("c", "catalog", 1249), ("d", "catalog", 1250), ("e", "pulsar", 300), ("f", "bits", 400)]
    plan = sa.subset_plan(spark.createDataFrame(rows, "series_id string, family string, n bigint"), family_config(spark))
    got = {r["series_id"]: (r["size"], r["n_subsets"], r["mode"]) for r in plan.collect()}
    assert got == {
        "b": (30, 75, "adaptive"),
        "c": (124, 75, "adaptive"),
        "d": (3700, 100, "fixed"),
        "e": (250, 100, "fixed-family"),
        "f": (40, 75, "adaptive"),
    }
    windows = sa.subset_windows(plan)
    bad = windows.join(plan.select("series_id", "n"), "series_id").filter("start is not null and (start < 0 or start + size > n)")
    assert bad.count() == 0
    # too short for its subsets: planned, but without a start
    assert windows.filter("series_id = 'd' and start is null").count() == 100


def test_windows_cover_all_starts(spark):
    plan = spark.createDataFrame([("s", "x", 40, 30, 5000)], "series_id string, family string, n bigint, size int, n_subsets int")
    counts = sa.subset_windows(plan).groupBy("start").count().collect()
    assert sorted(r["start"] for r in counts) == list(range(11))
    assert max(r["count"] for r in counts) < 2 * min(r["count"] for r in counts)


def test_subset_samples_exact(spark, samples, noise):
    windows = spark.createDataFrame(
        [("long", "f", 0, 1234, 300), ("long", "f", 1, 0, 30), ("short", "f", 0, 303, 30)],
        "series_id string, family string, subset_id int, start bigint, size int",
    )
    got = sa.subset_samples(samples, windows)
    assert by_series(got.filter("series_id = 'long' and subset_id = 0"))["long"] == list(noise["long"][1234:1534])
    assert by_series(got.filter("series_id = 'short'"))["short"] == list(noise["short"][303:333])


def test_folds(spark):
    rows = [("a", i) for i in range(100)] + [("b", i) for i in range(2)]
    got = sa.folds(spark.createDataFrame(rows, "series_id string, subset_id int"))
    counts = {(r["fold"], r["series_id"]): r["count"] for r in got.groupBy("fold", "series_id").count().collect()}
    assert counts == {(f, "a"): 67 for f in range(3)}
    assert got.distinct().count() == got.count()


def test_disc_members_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    points = spark.createDataFrame(
        [("m", i, i, 0.0, *map(float, v)) for i, v in enumerate(p)],
        "series_id string, idx bigint, pixel int, value double, x double, y double, z double",
    )
    centres = points.filter("pixel < 12").select("series_id", F.col("pixel").alias("subset_id"), "x", "y", "z")
    for radius in (0.1, 0.7, 2.5, np.pi):
        got = {(r["subset_id"], r["pixel"]) for r in sa.disc_members(points, centres, radius).collect()}
        want = {(c, i) for c in range(12) for i in range(400) if p[c] @ p[i] >= np.cos(radius)}
        assert got == want


def results_of(spark, values):
    rows = [("s", "ledger", k, 0, 250, v, v, 81, 7) for k, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "series_id string, family string, subset_id int, start bigint, size int, d_f double, mean_h double, "
        "n_valid_q bigint, n_scales_used bigint",
    )


def test_core_drops_outliers(spark):
    values = [1.0, 1.1, 0.9, 1.05, 0.95, 40.0, None]
    marked = su.mad_core(results_of(spark, values)).orderBy("subset_id").collect()
    assert [r["in_core"] for r in marked] == [True] * 5 + [False, False]


def test_small_core_falls_back_to_all(spark):
    marked = su.mad_core(results_of(spark, [1.0, 5.0])).collect()
    assert all(r["in_core"] for r in marked)


def test_z_test(spark):
    import math

    values = [1.2, 1.25, 1.15, 1.3, 1.22]
    got = su.dataset_summary(results_of(spark, values), family_config(spark, [FAMILY])).first()
    x = np.array(values)
    z = (x.mean() - 1.19) / (x.std() / np.sqrt(5))
    assert got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    flat = su.dataset_summary(results_of(spark, [1.0, 1.0, 1.0]), family_config(spark, [FAMILY])).first()
    assert flat["z"] is None and flat["p_value"] is None


def spectra_of(spark, curves):
    rows = [(n, k, q, v) for n, h in curves.items() for (k, q), v in zip(enumerate(Q_GRID), h)]
    return spark.createDataFrame(rows, "series_id string, q_pos int, q double, h double")


def test_interpolation_holds_ends(spark):
    x = np.linspace(1.0, 0.2, 81) ** 2
    holes = [None if k in (0, 1, 30, 31, 32, 80) else float(v) for k, v in enumerate(x)]
    one = [0.5] + [None] * 80
    got = by_series(co.interpolate(spectra_of(spark, {"a": holes, "b": one})), "q_pos", "h")
    known = [k for k, v in enumerate(holes) if v is not None]
    assert "b" not in got
    np.testing.assert_allclose(got["a"], np.interp(Q_GRID, np.array(Q_GRID)[known], x[known]), rtol=1e-12)


def test_constant_spectrum_has_no_correlation(spark):
    curves = {"a": [1.0] * 81, "b": [0.01 * k for k in range(81)], "c": [0.02 * k for k in range(81)]}
    pairs = {(r["ds_a"], r["ds_b"]): r["abs_corr"] for r in co.pair_correlations(co.pack(spectra_of(spark, curves)), "TCI").collect()}
    assert pairs[("a", "b")] is None and pairs[("b", "c")] == pytest.approx(1.0)


def test_one_dataset_has_no_index(spark):
    packed = co.pack(spectra_of(spark, {"a": [0.01 * k for k in range(81)]}))
    assert co.mean_coherence(packed, "tci").first()["tci"] is None
    assert co.mean_coherence(packed, "tci", legacy_zero=True).first()["tci"] == 0.0


def test_blend_is_the_plain_mean(spark):
    indices = spark.createDataFrame([(-1, 0.6, 0.9), (0, None, 0.5)], "fold int, tci double, mci double")
    draws = co.bootstrap_draws(indices)
    mixed = co.blend(draws)
    assert mixed.filter("fold = -1 and abs(tmci - (tci + mci) / 2) > 1e-12").count() == 0
    got = {r["fold"]: r for r in co.assemble(indices).collect()}
    assert got[-1]["tmci"] == pytest.approx(0.75, abs=0.01)
    assert got[-1]["ci_lo"] < got[-1]["tmci"] < got[-1]["ci_hi"]
    assert got[0]["tmci"] is None and got[0]["ci_lo"] is None


def test_denoise_by_family(spark, samples, noise):
    df = samples.withColumn("family", F.when(F.col("series_id") == "long", "z").otherwise("u"))
    got = by_series(denoise(df, ("series_id",), {"z": "z_score", "u": "unit_std"}))
    x = noise["long"]
    np.testing.assert_allclose(got["long"], (x - x.mean()) / (x.std() + 1e-10), rtol=1e-9)
    np.testing.assert_allclose(got["walk"], noise["walk"] / noise["walk"].std(), rtol=1e-9)


def test_every_recipe_runs_on_subsets(spark, samples):
    for recipe in ("strain", "lines", "pulsar", "z_score", "unit_std"):
        family = Family("f", 250, 5, 1.19, 0.04, recipe, SCALES)
        tagged = samples.filter("series_id <> 'short'").withColumn("family", F.lit("f"))
        plan = sa.subset_plan(rn.series_lengths(tagged), family_config(spark, [family]))
        windows = sa.subset_windows(plan)
        results = rn.subset_results(rn.measure_subsets(tagged, windows, plan, [family]), windows)
        assert results.count() == 10


def test_input_partitioning_does_not_matter(spark, samples):
    def measured(df):
        tagged = df.withColumn("family", F.lit("ledger"))
        plan = sa.subset_plan(rn.series_lengths(tagged), family_config(spark, [FAMILY]))
        windows = sa.subset_windows(plan)
        measures = rn.measure_subsets(tagged, windows, plan, [FAMILY])
        return sorted(rn.subset_results(measures, windows).select("series_id", "subset_id", F.round("d_f", 9)).collect())

    assert measured(samples) == measured(samples.repartition(13, F.rand(1)))


def test_whole_run(spark, noise, tmp_path):
    rows = [(n, "ledger", i, float(v)) for n, x in noise.items() for i, v in enumerate(x)]
    rows += [("flat", "ledger", i, 1.0) for i in range(500)] + [("tiny", "ledger", i, float(i)) for i in range(9)]
    samples = spark.createDataFrame(rows, "series_id string, family string, idx bigint, value double")
    out = rn.run(spark, samples, str(tmp_path), [FAMILY], run_id="r1")
    status = {r["series_id"]: (r["status"], r["reason"]) for r in out.health.collect()}
    assert status["flat"] == ("FAIL", "No valid D_f") and "tiny" not in status
    assert {status[n][0] for n in noise} <= {"OK", "WARN"}
    assert out.results.filter("series_id = 'flat' and d_f is null").count() == 75
    full = out.indices.filter("fold = -1").first()
    assert full["tmci"] == pytest.approx((full["tci"] + full["mci"]) / 2, abs=0.01)
    assert out.indices.count() == 4
    assert out.pairs.filter("index = 'TCI'").count() == 3 and out.pairs.filter("index = 'MCI'").count() == 3

    base = tmp_path / "r1"
    flat = spark.read.option("header", True).csv(str(base / "flat_csv"))
    assert flat.columns == list(ex.FLAT_COLUMNS)
    kinds = {r["type"]: r["count"] for r in flat.groupBy("type").count().collect()}
    assert kinds == {"TCI": 3, "MCI": 3, "TMCI_fold": 3, "MFDFA_subset": out.results.count(), "GLOBAL": 1}
    doc = json.loads("".join(p.read_text() for p in (base / "index_json").glob("part-*")))
    assert doc["tci"] == full["tci"] and len(doc["tmci"]["bootstrap"]["tmci"]) == 500
    assert len(doc["tmci"]["crossval"]["folds"]) == 3
    docs = [json.loads(l) for p in (base / "dataset_json").glob("part-*") for l in p.read_text().splitlines()]
    assert {d["series_id"] for d in docs} == set(noise) | {"flat"}
    long = next(d for d in docs if d["series_id"] == "long")
    assert len(long["subsets"]) == 20 and len(long["spectrum"]) == 81 and len(long["subsets"][0]["hq"]) <= 81
    snaps = [json.loads(l) for p in (base / "snapshot_json").glob("part-*") for l in p.read_text().splitlines()]
    assert {s["series_id"]: s["length_full"] for s in snaps}["long"] == 5000
    manifest = spark.read.json(str(base / "manifest_json")).first()
    import hashlib

    assert hashlib.sha256(manifest["definition"].encode()).hexdigest() == manifest["sha256"]


def test_row_cap(spark):
    results = results_of(spark, [1.0] * 30)
    assert [r["subset_id"] for r in ex.first_subsets(results, 7).collect()] == list(range(7))


def test_release_removes_what_was_landed(spark):
    from pathlib import Path

    from scalefold.session import land, release, run_dir

    table = land(spark.range(5), "five")
    assert table.count() == 5 and list(Path(run_dir(spark)).glob("five-*"))
    release(spark)
    assert not Path(run_dir(spark)).exists()
