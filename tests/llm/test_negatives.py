"""Hard negatives from cover trees against a plain search."""

import math

import numpy as np
import pytest

from scalefold.llm import covertree, topk, vector_queries
from tests.llm.samples import same_rows


def plain(rows, anchors, k=5, low=80, high=100):
    out = []
    for own, label, vec in sorted(set(anchors)):
        scored = [(-sum(a * b for a, b in zip(vec, w)), i, y) for i, y, w in rows if i != own and len(w) == len(vec)]
        positives = sorted((s, i) for s, i, y in scored if y == label)[:k]
        for p, positive in positives:
            inside = sorted((s, i) for s, i, y in scored if y != label and low * -p <= 100 * -s <= high * -p)
            out += [(own, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(inside[:k], 1)]
    return out


def table(rng):
    """Clusters, a vector that a third of all rows hold, ties, repeated rows, other dimensions and unsound rows."""
    centres = rng.normal(size=(8, 6))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.3 * rng.normal(size=6)], int(rng.integers(4))) for i in range(500)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 1.0, 0.75], i % 3) for i in range(260)]
    rows += [(2000 + i, [float(x) for x in rng.integers(-2, 3, 6) / 2], i % 4) for i in range(120)]
    rows += [(3000, [0.0] * 6, 1), (3100, [1.0, 2.0], 1), (3101, [1.0, 1.5], 1), (3102, [1.0, 1.25], 2), (3103, [0.9, 1.4], 0)]
    rows += [rows[0], rows[100], rows[100], rows[37], rows[37]]
    rows += [(4000, None, 1), (4001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (4100, [math.nan] * 6, 1), (4200, [math.inf] * 6, 1)]
    rows += [(None, [1.0] * 6, 1), (4300, [1.0] * 6, None), (4400, [], 2)]
    return rows


def vectors(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, label int, score string, number int")
    return df.repartition(4).withColumn("vec", topk.quantised("embedding", 256.0))


@pytest.mark.parametrize("leaf, fan, shard, cells", [(64, 16, 4096, 256), (4, 3, 60, 5), (4, 3, 60, 0)])
def test_hard_negatives(spark, monkeypatch, leaf, fan, shard, cells):
    for name, value in (("LEAF_ROWS", leaf), ("FAN", fan), ("SHARD_ROWS", shard), ("MOST_CELLS", cells), ("STEP_LEAVES", 3), ("PACK_ROWS", 5), ("SLICE_PACKS", 1)):
        monkeypatch.setattr(covertree, name, value)
    rows = table(np.random.default_rng(8))
    df = vectors(spark, rows)
    sound = [
        (i, y, tuple(math.floor(256 * x) for x in v))
        for i, v, y in rows
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    got = covertree.hard_negatives(df, df.filter("vec_id % 100 = 0"))
    same_rows(got, plain(sound, [r for r in sound if r[0] % 100 == 0]))


def test_empty_tables(spark):
    df = vectors(spark, table(np.random.default_rng(1)))
    none = df.limit(0)
    assert covertree.hard_negatives(df, none).count() == 0
    assert covertree.hard_negatives(none, df).count() == 0


def test_large_scores_are_exact():
    rng = np.random.default_rng(2)
    rows = rng.integers(-(1 << 28), 1 << 28, (300, 5))
    tree = covertree.CoverTree(np.arange(300), np.zeros(300, np.int64), rows, float(np.sqrt((rows.astype(float) ** 2).sum(1).max())) * (1 + 1e-12))
    asked = covertree.Searches(rows[:3], np.array([-1, -1, -1]), np.zeros(3, np.int64), np.full((3, 1), covertree.LEAST), np.full((3, 1), covertree.MOST))
    who, _, at, score = tree.search(asked, 4, True)
    for q in range(3):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q], r)), i) for i, r in enumerate(rows))[:4]
        assert [(-s, i) for s, i in zip(score[who == q], tree.ids[at[who == q]])] == exact


def test_clusters_are_skipped():
    """Where rows lie in clusters, bounds leave most of the tree closed."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = np.floor(256 * (centres[rng.integers(40, size=4000)] + 0.02 * rng.normal(size=(4000, 16)))).astype(np.int64)
    tree = covertree.CoverTree(np.arange(4000), np.zeros(4000, np.int64), rows, float(np.sqrt((rows.astype(float) ** 2).sum(1).max())) * (1 + 1e-12))
    n = 50
    asked = covertree.Searches(rows[:n], np.arange(n), np.zeros(n, np.int64), np.full((n, 1), covertree.LEAST), np.full((n, 1), covertree.MOST))
    who, _, at, score = tree.search(asked, 5, True)
    exact = np.sort(rows[:n] @ rows.T - np.eye(n, 4000, dtype=np.int64) * (1 << 40), axis=1)[:, ::-1][:, :5]
    assert (score.reshape(n, 5) == exact).all()
    assert tree.opened < n * 4000 * 0.2


def test_query(spark):
    assert vector_queries.op11_hard_negatives(spark, "/root/testdata/sf0.001").count() > 0
