"""Near-duplicates by SimHash: majority fingerprints, byte-position index, components.

Two fingerprints of eight bytes that differ in at most d bits share at least
8 - d bytes at their positions. The index holds each distinct fingerprint under
every set of 8 - d positions with the bytes there, so any pair with that many
matches meets in a list; pairs in a list are tallied byte by byte, those that
reach the count are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.llm.graph import components
from scalefold.llm.text import LOWER, column_bytes, tidied, unused
from scalefold.session import land

BYTES = 8
#: Rows of one list compared in one group; longer lists are cut into pairs of blocks.
BLOCK = 2048
#: Hashes turned into bits at a time.
_STEP = 1 << 16


def _fingerprint(text: bytes, words_per_shingle: int, seed: int) -> int:
    """A bit is 1 when over half of the shingle hashes have it; without words 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    k = min(words_per_shingle, len(words))
    begin = (end - length + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(begin, end[k - 1 :].tolist())), np.uint64, len(begin))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        octets = hashes[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    documents: DataFrame, text: str = "text", words_per_shingle: int = 4, seed: int = 42, carry: list[str] | None = None
) -> DataFrame:
    """Every row with its signed 64-bit ``fp``; null and word-free texts have 0."""
    keep = [c for c in (documents.columns if carry is None else carry) if c != "fp"]

    hidden = unused(documents, "_text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_fingerprint(t, words_per_shingle, seed) for t in column_bytes(batch, hidden)]
            fp = pa.array(np.array(own, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], names=[*keep, "fp"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*keep).schema)
    return documents.select(*keep, F.col(text).alias(hidden)).mapInArrow(tidied(mark), f"{kinds}fp long")


def _forest(left: np.ndarray, right: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """Links that join what the matching pairs of left x right join, fewer than there are rows."""
    names, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    part_of, out = np.arange(len(names)), []
    octets = left.view(np.uint8).reshape(-1, BYTES), right.view(np.uint8).reshape(-1, BYTES)
    rows = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), rows):
        some = octets[0][at : at + rows]
        shared = np.zeros((len(some), len(right)), np.uint8)
        for p in range(BYTES):
            shared += some[:, p, None] == octets[1][None, :, p]
        i, j = np.nonzero(shared >= least)
        differ = np.bitwise_count(left[at + i] ^ right[j])
        near = (differ <= most) & (differ > 0)
        i, j = i[near], code[len(left) + j[near]]
        turn = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
        for s, e in zip(turn[:-1], turn[1:]):
            x = code[at + i[s]]
            parts, first = np.unique(part_of[j[s:e]], return_index=True)
            new = parts != part_of[x]
            if new.any():
                out += [(int(names[x]), int(names[y])) for y in j[s:e][first[new]]]
                part_of[np.isin(part_of, parts[new])] = part_of[x]
    return out


def links(distinct_fp: DataFrame, most: int = 4) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints; they join exactly what pairs at most ``most`` bits apart join.

    A list of more than BLOCK fingerprints is compared block by block, each pair
    of blocks in a group of its own, so no group grows with the data. From each
    group come links of a spanning forest only, never all its pairs.
    """
    if not 0 <= most < BYTES:
        raise ValueError("at least one byte position has to match")
    least = BYTES - most
    masks = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(BYTES), least)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
                                for i, m in enumerate(signed))))
    index = distinct_fp.select("fp", place.alias("at")).select("fp", "at.mask", "at.bytes")
    lists = index.groupBy("mask", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # block i meets the blocks j >= i: as the left side of (i, j), as the right side of (j, i)
    meets = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")),
    )
    # the size Spark expects of the index leaves out the 70 places of a fingerprint: unhinted, all of it may be broadcast
    groups = (
        index.join(lists.hint("merge"), ["mask", "bytes"])
        .withColumn("own", own)
        .select("mask", "bytes", "fp", "own", F.explode(meets).alias("pair"))
        .groupBy("mask", "bytes", "pair")
        .agg(F.collect_list(F.when(F.col("own") == F.col("pair.i"), F.col("fp"))).alias("l"),
             F.collect_list(F.when(F.col("own") == F.col("pair.j"), F.col("fp"))).alias("r"))
        .select("l", "r")
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for l, r in zip(*(batch.column(c) for c in "lr")):
                left, right = (np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in (l, r))
                found.update(_forest(left, right, least, most))
            pairs = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return groups.mapInArrow(tidied(match), "a long, b long").distinct()


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 4,
    most: int = 4,
    seed: int = 42,
) -> DataFrame:
    """``(<id>, fp, component_id)`` for every row; the component is named by its least id.

    Texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer
    words than a shingle is one shingle; null, empty and word-free texts have
    fingerprint 0 and link like any other. Rows of equal fingerprint are one
    component, so copies collapse before the index. A null id keeps its row; a
    component of null ids alone is named null. Repeated rows stay, an empty table
    gives an empty result, other columns are not read.
    """
    marked = land(
        fingerprints(documents.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), "_t",
                     words_per_shingle, seed, carry=["_id"]),
        "fingerprints",
    )
    rooted = _roots(marked, most)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def _roots(marked: DataFrame, most: int) -> DataFrame:
    """``(fp, least, root)`` for each distinct fingerprint: its least ``_id`` and the least fingerprint it reaches."""
    classes = land(marked.groupBy("fp").agg(F.min("_id").alias("least")), "classes")
    joined = components(links(classes.select("fp"), most), "a", "b")
    return classes.join(joined, classes.fp == joined.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def keep_one(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 4,
    most: int = 4,
    seed: int = 42,
) -> DataFrame:
    """One row of each component, that of the least id (null last), all columns as they are.

    Rows equal in id and text are one document; of ids that repeat with other texts each
    component keeps its own.
    """
    name = F.xxhash64(F.col(id_col), F.col(text))
    marked = land(
        fingerprints(documents.select(name.alias("_name"), F.col(id_col).alias("_id"), F.col(text).alias("_t")), "_t",
                     words_per_shingle, seed, carry=["_name", "_id"]),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_name")).alias("first")
    kept = marked.join(_roots(marked, most).select("fp", "root"), "fp").groupBy("root").agg(first)
    kept = kept.select(F.col("first._name").alias("__kept"))
    named = documents.withColumn("__name", name)
    return named.join(kept, named["__name"] == kept["__kept"], "left_semi").dropDuplicates(["__name"]).drop("__name")
