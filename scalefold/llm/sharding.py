"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

A partial partition is a list of parts with their bytes. Every group starts as one, with
all its bytes in one part. The two with the largest spread (most minus least bytes) are combined
again and again, the largest part of one with the smallest of the other, until one
is left; its parts are the shards.

Groups are too many for one task, so blocks of them are first differenced into
bundles, many more than there are shards, and the bundles are the items of the next
level. Groups too large to be evened out in a block, a bounded number, wait for the last level.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.operators.indexing import dense_index
from scalefold.session import land

#: Items of one differencing task, and the bundles it leaves.
BLOCK_ITEMS, BUNDLES = 4096, 256
#: Items of the last level.
LAST_ITEMS = 16384
#: A group of more than this share of a shard waits for the last level: there are fewer than shards x LARGE of them.
LARGE = 64
#: A group with more than one in HOT of all rows is joined by broadcast: there are fewer than HOT of them.
HOT = 1000
#: Rows of a shard that one task may number.
TASK_ROWS = 20_000


def differenced(weights: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item. Of equal spreads the older partial partition goes first, items in the order given."""
    n = len(weights)
    if not n:
        return np.zeros(0, np.int64)
    sums: dict[int, np.ndarray] = {}
    for i, w in enumerate(weights):
        sums[i] = np.zeros(parts, np.int64)
        sums[i][0] = w
    spread = np.asarray(weights) if parts > 1 else np.zeros(n, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(spread)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        place = np.empty(parts, np.int64)
        place[order] = np.arange(parts)
        new = n + len(merged)
        merged.append((a, b, place))
        sums[new] = both = both[order]
        heapq.heappush(heap, (int(both[-1] - both[0]), new))
    # unwound from the last to the first: where each part of an early partition ended
    ended = {heap[0][1]: np.arange(parts)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, place = merged[k]
        whole = ended.pop(n + k)
        ended[a], ended[b] = whole[place], whole[place[::-1]]
    return np.array([ended[i][0] for i in range(n)])


def _level(items: DataFrame, blocks: int, parts: int) -> DataFrame:
    """``(key, weight, bundle)``: every block of ``items(key, weight)`` differenced into ``parts`` bundles of its own."""
    block = F.pmod(F.xxhash64("key"), F.lit(blocks).cast("long"))
    gathered = items.groupBy(block.alias("block")).agg(F.collect_list(F.struct("key", "weight")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(batch.column("block").to_pylist(), batch.column("items")):
                keys, weights = held.values.flatten()
                weights = np.asarray(weights, dtype=np.int64)
                first = np.lexsort((np.array(keys.to_pylist(), dtype=object), -weights))
                part = differenced(weights[first], parts)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(first)), pa.array(weights[first]), pa.array(block * parts + part)],
                    names=["key", "weight", "bundle"],
                )

    return gathered.mapInArrow(run, "key binary, weight long, bundle long")


def karmarkar_karp(groups: DataFrame, shards: int) -> DataFrame:
    """``(key, shard)`` for ``groups(key binary, weight long)``; keys are distinct."""
    count, total = groups.agg(F.count("*"), F.sum("weight")).first()
    if count <= LAST_ITEMS:
        return _level(groups, 1, shards).select("key", F.col("bundle").cast("int").alias("shard"))
    large = groups.filter(F.col("weight") * shards * LARGE > total)
    small = groups.filter(F.col("weight") * shards * LARGE <= total)
    items, chain = small, []
    while (n := items.count()) > LAST_ITEMS:
        made = land(_level(items, -(-n // BLOCK_ITEMS), BUNDLES).withColumn("bundle", F.encode(F.col("bundle").cast("string"), "utf-8")), "bundles")
        chain.append(made.select("key", F.col("bundle").alias("next")))
        items = made.groupBy(F.col("bundle").alias("key")).agg(F.sum("weight").alias("weight"))
    # keys of groups and of bundles are told apart by their first byte
    last = items.select(F.concat(F.encode(F.lit("b"), "utf-8"), "key").alias("key"), "weight").unionByName(
        large.select(F.concat(F.encode(F.lit("g"), "utf-8"), "key").alias("key"), "weight")
    )
    final = land(_level(last, 1, shards), "shards")
    own = F.expr("substring(key, 2)")
    kind = F.expr("substring(key, 1, 1)") == F.encode(F.lit("b"), "utf-8")
    shard = F.col("bundle").cast("int").alias("shard")
    placed = final.filter(kind).select(own.alias("next"), shard)
    for step in reversed(chain):
        placed = step.join(placed, "next").select(F.col("key").alias("next"), "shard")
    return placed.select(F.col("next").alias("key"), "shard").unionByName(final.filter(~kind).select(own.alias("key"), shard))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``docs``: equal texts share a shard, shards have near equal bytes.

    ``size`` is the bytes of the text in UTF-8 and one more; a null text has none, a checksum of 0,
    and null texts are a group of their own, apart from empty ones. ``slot`` counts the rows of a shard from 0 in
    the order of ids, nulls first. Repeated rows are placed each. A group larger than
    a shard's share stays whole, and the others are evened out around it. Reruns give the same result, as ties go by the text's
    hash. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("binary")
    key = F.when(F.col(text_col).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text, 256)))
    sized = land(
        docs.select(
            F.col(id_col).alias(id_col),
            (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
            key.alias("key"),
        ),
        "sized",
    )
    groups = land(sized.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("rows")), "groups")
    assigned = land(groups.select("key", "rows").join(karmarkar_karp(groups.select("key", "weight"), shards), "key"), "assigned")
    rows = sized.count()
    hot = F.broadcast(assigned.filter(F.col("rows") * HOT > rows).select("key", "shard"))
    rest = sized.join(hot.select("key"), "key", "left_anti")
    placed = sized.join(hot, "key").unionByName(rest.join(assigned.select("key", "shard"), "key"))
    slots = dense_index(land(placed, "placed"), ["shard"], [id_col, "key"], "slot", TASK_ROWS)
    return slots.select(id_col, "size", "text_crc32", "shard", "slot")
