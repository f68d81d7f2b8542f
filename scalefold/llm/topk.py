"""Exact top-k inner products by the threshold algorithm over sorted lists per dimension.

Candidates are packed into shards. For each dimension a shard keeps its
candidates sorted by that component. A pack of queries goes down the lists together: sorted access takes
every list from the ends its unfinished queries ask for, all to the same depth; what turns up for one of them is scored in full for
all of them by random access, once. The threshold of a query is the score of an imagined vector made of the components
last seen; once it is below the query's k-th score, no unseen candidate can enter, nor tie, and the query leaves the
pack. When every candidate has turned up the lists are left, however far they still go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scalefold.session import land

SHARD_ROWS = 8192
QUERY_ROWS = 512
#: List entries taken at first; the depth then doubles, so no round repeats more than half of the work.
FIRST_DEPTH = 32


def quantised(vector: str, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of every component as a long array; null for a vector that is null or has a
    null or non-finite component."""
    xs = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(xs, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    floors = F.transform(xs, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return F.when(F.col(vector).isNotNull() & sound, floors)


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """``(pack, ids, vectors)``: rows dealt by hash to packs of about ``rows``, one dimension count a pack."""
    dims = vectors.withColumn("dim", F.size("vec"))
    # one row for each length of vectors: D lengths take over D^2 / 2 components, so this stays small at any size
    counts = dims.groupBy("dim").agg(F.count("*").alias("n"))
    dealt = dims.join(F.broadcast(counts), "dim")
    pack = F.pmod(F.xxhash64("id", "vec"), F.ceil(F.col("n") / rows).cast("long"))
    return (
        dealt.withColumn("pack", pack)
        .groupBy("dim", "pack")
        .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    )


class _Lists:
    """One shard: vectors, ids and, per dimension, the order of its rows by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, queries: np.ndarray, skip: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best ``k`` rows for each query, ``skip`` being the query's own id.

        ``met`` then tells how many rows each query was scored against.
        """
        n = len(self.ids)
        scorer = _Scorer(queries, self.vectors)
        rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
        score = np.full((len(queries), n), scorer.least, scorer.kind)
        highest = np.full((len(queries), k), scorer.least, scorer.kind)
        seen = np.zeros(n, bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(queries)
        self.met = np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        begin, depth = 0, min(FIRST_DEPTH, n)
        while len(live):
            turned = np.zeros(n, bool)
            turned[self.order[n - depth : n - begin, rising[live].any(axis=0)]] = True
            turned[self.order[begin:depth, falling[live].any(axis=0)]] = True
            if depth == n:  # a query of zeros asks for no list and meets every row with score 0
                turned[:] = True
            fresh = np.flatnonzero(turned & ~seen)
            seen[fresh] = True
            part = scorer.products(live, fresh)
            part[self.ids[fresh] == skip[live, None]] = scorer.least
            score[live[:, None], fresh] = part
            both = np.concatenate([highest[live], part], axis=1)
            highest[live] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            kth = highest[live].min(axis=1)
            bound = rising[live] @ self.sorted[n - depth] + falling[live] @ self.sorted[depth - 1]
            ended = (kth > scorer.least) & (bound < kth) | seen.all()
            for row, floor in zip(live[ended], kth[ended]):
                mine = np.flatnonzero((score[row] >= floor) & (score[row] > scorer.least))
                got = score[row, mine].astype(np.int64)
                first = np.lexsort((self.ids[mine], -got))[:k]
                best[row] = self.ids[mine[first]], got[first]
                self.met[row] = seen.sum()
            live = live[~ended]
            begin, depth = depth, min(2 * depth, n)
        return best


class _Scorer:
    """Integer inner products of queries and candidates; in floating point where that is exact."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray):
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        self.kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        self.least = np.iinfo(np.int64).min if self.kind is np.int64 else -np.inf
        self.queries, self.vectors = queries.astype(self.kind), vectors.astype(self.kind)

    def products(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return self.queries[queries] @ self.vectors[vectors].T


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "vec", k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products for each query, its own id apart.

    ``vectors`` and ``queries`` hold ids and long arrays. Ties go to the smaller
    id; fewer candidates give fewer rows. Null ids, null and empty arrays take no part; a query meets
    vectors of its own number of dimensions. Repeated rows of an id are
    candidates each, repeated query rows are answered once. Empty tables give an empty result.

    Shards hold about SHARD_ROWS rows and meet queries in packs of QUERY_ROWS:
    each (shard, pack) is one row of bounded size, and leaves at most k rows a query.
    """
    def sound(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")).filter("id is not null and size(vec) > 0")

    shards = land(_packed(sound(vectors), SHARD_ROWS).withColumnRenamed("pack", "shard"), "shards")
    packs = land(_packed(sound(queries).dropDuplicates(["id", "vec"]), QUERY_ROWS), "packs")
    held = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    # each pack is sent to every shard of its dimensions
    sent = packs.join(held, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard"), F.col("rows").alias("asked")
    )
    met = shards.join(sent, ["dim", "shard"]).select("rows", "asked")

    def unpack(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = rows.values.flatten()
        return np.asarray(ids, dtype=np.int64), np.asarray(vectors.flatten(), dtype=np.int64).reshape(len(ids), -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, known = None, None
        for batch in batches:
            for rows, asked in zip(batch.column("rows"), batch.column("asked")):
                if known is None or not known.equals(rows):
                    known, lists = rows, _Lists(*unpack(rows))
                ids, vectors = unpack(asked)
                found = lists.top(vectors, ids, k)
                many = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, many)), pa.array(np.concatenate([f[0] for f in found])),
                     pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
