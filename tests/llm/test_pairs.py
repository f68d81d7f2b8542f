"""SimHash, components and exact top-k against plain versions."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from scalefold.llm import graph, simhash, topk, vector_queries
from tests.llm.samples import documents, frame, same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(fps, most):
    return [(a, b) for a, b in combinations(sorted(set(fps)), 2) if (a ^ b).bit_count() <= most]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_duplicates(spark):
    rows = documents()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = plain_roots(set(fps), near(fps, 4))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    same_rows(simhash.near_duplicates(frame(spark)), [(r[0], signed(f), least.get(root[f])) for r, f in zip(rows, fps)])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_links_join_what_pairs_join(spark, monkeypatch, block):
    """Also where one list is far longer than a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        for _ in range(3):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(16), 3)) for _ in range(60)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert plain_roots(fps, found) == plain_roots(fps, near(fps, 4))


def test_the_index_of_fingerprints_is_not_broadcast(spark, tmp_path):
    """Its expected size is that of the fingerprints, a seventieth of what it holds."""
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(str(tmp_path / "fp"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(70)]
    random.Random(2).shuffle(path)
    links = path + [(500, 501 + i) for i in range(50)] + [(900, 901), (901, 900), (902, 902)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    want = plain_roots({n for p in links if p[0] != p[1] for n in p}, links[:-1])
    assert got == want


def plain_top(vectors, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(230)]
    rows += [(400 + i, [0.5] * 6) for i in range(40)] + [(600, [0.0] * 6), (601, [1.0, 2.0]), (620, [1.5, 2.0])]
    rows += [(700, None), (701, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (720, [math.nan] * 6), (740, [math.inf] * 6), (None, [1.0] * 6), (760, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = df.select("vec_id", topk.quantised("embedding").alias("vec"))
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = [(i, v) for i, v in sound if i % 20 == 0]
    same_rows(topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=5), plain_top(sound, asked, 5))
    none = vectors.limit(0)
    assert topk.top_k(vectors, none).count() == 0 and topk.top_k(none, vectors).count() == 0


def test_ended_early_is_still_exact():
    """The threshold stops the search well before the ends of the lists."""
    rng = np.random.default_rng(0)
    lists = topk._Lists(np.arange(5000), rng.integers(-60, 60, (5000, 3)))
    asked = rng.integers(-60, 60, (9, 3))
    for q, (ids, scores) in zip(asked, lists.top(asked, np.full(9, -1), 20)):
        exact = lists.vectors @ q
        order = np.lexsort((lists.ids, -exact))[:20]
        assert ids.tolist() == lists.ids[order].tolist() and scores.tolist() == exact[order].tolist()
    assert lists.met.max() < 2500


def test_lists_are_left_when_all_rows_turned_up():
    """Ties, huge components, zero queries, own ids and fewer rows than asked for."""
    rng = np.random.default_rng(1)
    for size, width, rows in ((2, 4, 300), (60, 64, 2000), (1 << 28, 8, 200), (5, 3, 7)):
        vectors = rng.integers(-size, size + 1, (rows, width))
        ids = rng.permutation(rows)
        lists = topk._Lists(ids, vectors)
        asked, own = np.concatenate([vectors[:5], np.zeros((1, width), np.int64)]), np.append(ids[:5], -1)
        for q, me, (found, scores) in zip(asked, own, lists.top(asked, own, 20)):
            exact = vectors.astype(object) @ q.astype(object)
            order = sorted((i for i in range(rows) if ids[i] != me), key=lambda i: (-exact[i], ids[i]))[:20]
            assert found.tolist() == ids[order].tolist() and scores.tolist() == [exact[i] for i in order]


def test_query_of_embeddings(spark):
    assert vector_queries.op3_top_k(spark, "/root/testdata/sf0.001").count() > 0
