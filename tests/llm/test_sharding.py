"""Karmarkar-Karp shards against a plain version on lists of members."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from scalefold.llm import shard_queries, sharding
from tests.llm.samples import documents, frame


def plain_parts(weights, parts):
    """Partial partitions as lists of (bytes, members); the two of largest spread are joined, opposite ends together."""
    made = [[(w, [i])] + [(0, [])] * (parts - 1) for i, w in enumerate(weights)]
    queue = [(p[-1][0] - p[0][0], number, p) for number, p in enumerate(made)]
    fresh = len(queue)
    while len(queue) > 1:
        queue.sort(key=lambda e: e[:2])
        (_, _, a), (_, _, b) = queue[:2]
        joined = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda e: -e[0])
        queue = [*queue[2:], (joined[-1][0] - joined[0][0], fresh, joined)]
        fresh += 1
    return {i: part for part, (_, members) in enumerate(queue[0][2]) for i in members}


def plain_shards(rows, shards):
    """Shard of every text of a corpus that one task holds."""
    size = Counter()
    for r in rows:
        size[r[1]] += len((r[1] or "").encode()) + 1
    key = {t: b"" if t is None else sha256(t.encode()).digest() for t in size}
    order = sorted(size, key=lambda t: (-size[t], key[t]))
    part = plain_parts([size[t] for t in order], shards)
    return {t: part[i] for i, t in enumerate(order)}


def checked(got, rows, shards, text_of):
    """What holds for any right result; gives the bytes of each shard."""
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(shards):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id for r in mine] == sorted((r.doc_id for r in mine), key=lambda i: (i is not None, i))
    homes = defaultdict(set)
    for r in got:
        homes[text_of[r.doc_id] if r.doc_id is not None else r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    return [loads[s] for s in range(shards)]


def test_against_plain_lists(spark):
    rows = documents()
    got = sharding.balanced_shards(frame(spark), shards=5).collect()
    want = plain_shards(rows, 5)
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r[0], want[r[1]]) for r in rows)
    checked(got, rows, 5, {r[0]: r[1] for r in rows})


def test_many_random_lists():
    rng = random.Random(4)
    for _ in range(200):
        weights = sorted((rng.choice([1, 1, 2, 5, 9, 40, 1000]) * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))), reverse=True)
        parts = rng.randrange(1, 7)
        got = sharding.differenced(np.array(weights, dtype=np.int64), parts)
        want = plain_parts(weights, parts) if weights else {}
        assert got.tolist() == [want[i] for i in range(len(weights))]


@pytest.mark.parametrize("hot", [0, 900])
def test_levels_of_bundles(spark, monkeypatch, hot):
    """Far more groups than a task takes, one text that a third of all rows share, all ways to join and number."""
    for name, value in (("BLOCK_ITEMS", 40), ("BUNDLES", 8), ("LAST_ITEMS", 100), ("TASK_ROWS", 50), ("HOT", 10)):
        monkeypatch.setattr(sharding, name, value)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=int(rng.lognormvariate(4, 1)))) for _ in range(2000)]
    texts += ["copied by many " * 9] * hot + texts[:50] + [None, None, "", ""]
    rows = [(i, t, "en", "s", 1, "a", "b", "c", "d") for i, t in enumerate(texts)]
    got = sharding.balanced_shards(frame(spark, rows), shards=4).collect()
    loads = checked(got, rows, 4, dict(enumerate(texts)))
    again = sharding.balanced_shards(frame(spark, rows[::-1]), shards=4).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    whole = 9 * 15 * hot + hot
    if whole > sum(loads) / 4:  # the copies fill a shard, the rest is even
        assert max(loads) == whole
        loads.remove(whole)
    assert max(loads) - min(loads) <= 0.01 * sum(loads)


def test_a_group_larger_than_a_shard():
    weights = np.array([5000] + [7] * 300)
    part = sharding.differenced(weights, 4)
    loads = sorted(np.bincount(part, weights))
    assert loads[-1] == 5000 and loads[2] - loads[0] <= 7


def test_empty_table(spark):
    assert sharding.balanced_shards(frame(spark, [])).count() == 0


def test_query(spark):
    got = shard_queries.op13_balanced_shards(spark, "/root/testdata/sf0.001").collect()
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} == set(range(16))
