"""Removal of repeated passages of several lines.

``remove_repeated_passages`` takes the finest content-defined cut: the rolling hash over the hashes of
two neighbouring lines is a key at every line, so every repeated run of two or more lines is met in whole,
whatever is around it. Lines of pairs that occur anywhere else are compared byte by byte.

``remove_repeated_chunks`` is the coarse cut: the rolling hash ends a chunk where it meets a mask, and chunks of at
least two lines are compared. It finds a passage only from its first to its last inner boundary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.llm.text import column_bytes, mixed, steps, words_of
from scalefold.session import land

#: Lines the rolling hash reaches over.
WINDOW = 2
#: One line in so many ends a chunk.
SPREAD = 3
LEAST_LINES = 2
_NOT_NEWLINE = np.arange(256) != 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Chunks of several texts: text, first byte, byte behind the last, lines, 64-bit key. Blank lines belong to no chunk
    unless they are inside one."""
    words = words_of(texts, _NOT_NEWLINE)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    n = len(words.key)
    if not n:
        return (np.zeros(0, np.int64),) * 5
    roll = words.key.copy()
    for k in range(1, WINDOW):
        near = np.zeros(n, np.uint64)
        near[k:] = np.where(words.doc[k:] == words.doc[:-k], words.key[:-k], np.uint64(0))
        roll = mixed(roll * _BASE + near)
    last = np.append(words.doc[1:] != words.doc[:-1], True) | (roll % np.uint64(SPREAD) == 0)
    end = np.flatnonzero(last)
    begin = np.concatenate([[0], end[:-1] + 1])
    lines = end - begin + 1
    offset = np.arange(n) - np.repeat(begin, lines)
    power = np.cumprod(np.full(int(lines.max()), _BASE, np.uint64))
    key = mixed(np.add.reduceat(words.key * power[offset], begin) + lines.astype(np.uint64))
    doc = words.doc[begin]
    return doc, words.start[begin] - first[doc], words.end[end] - first[doc], lines, key.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column_bytes(batch, "text")
        for i, j in steps(texts):
            *_, lines, key = _chunks(texts[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(key[lines >= LEAST_LINES])], names=["key"])


PLACED = "ref long, key long, start int, size int, lines int"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ref = column_bytes(batch, "text"), batch.column("ref")
        for i, j in steps(texts):
            doc, start, end, lines, key = _chunks(texts[i:j])
            many = lines >= LEAST_LINES
            columns = [x[many].astype(np.int32) for x in (start, end - start, lines)]
            yield pa.RecordBatch.from_arrays(
                [ref.take(pa.array(doc[many] + i)), pa.array(key[many]), *(pa.array(x) for x in columns)],
                names=["ref", "key", "start", "size", "lines"],
            )


CUT = "ref long, n_removed_lines long, n_removed_chunks long, kept_sha256 string, removed array<struct<start int, end int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the chunks in ``gone`` and the line ends behind them."""
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, gone in zip(column_bytes(batch, "text"), batch.column("gone").to_pylist()):
            kept, at, removed = [], 0, []
            for g in sorted(gone, key=lambda g: g["start"]):
                kept.append(text[at : g["start"]])
                at = g["start"] + g["size"]
                at += text[at : at + 1] == b"\n"
                removed.append({"start": g["start"], "end": at})
            left = b"".join([*kept, text[at:]])
            values = (sum(g["lines"] for g in gone), len(gone), hashlib.sha256(left).hexdigest(), removed)
            for into, v in zip(out, values):
                into.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        names = ["ref", "n_removed_lines", "n_removed_chunks", "kept_sha256", "removed"]
        yield pa.RecordBatch.from_arrays([batch.column("ref"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=names)


def _listed(named: DataFrame, cut: DataFrame, id_col: str) -> DataFrame:
    """Every row of ``named`` with what was cut from its text."""
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long")
    base = named.select("_id", "ref", n_lines.alias("n_lines"), F.sha2("text", 256).alias("_sha"))
    zero = F.lit(0).cast("long")
    return base.join(cut, "ref", "left").select(
        F.col("_id").alias(id_col), "n_lines", F.coalesce("n_removed_lines", zero).alias("n_removed_lines"),
        F.coalesce("n_removed_chunks", zero).alias("n_removed_chunks"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        F.coalesce("removed", F.array().cast("array<struct<start int, end int>>")).alias("removed"),
    )


def remove_repeated_chunks(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<id>, n_lines, n_removed_lines, n_removed_chunks, kept_sha256, removed)`` for every row.

    Of equal chunks of at least LEAST_LINES lines the first stays: that of the least id (null first), then of the
    least place. ``removed`` are the byte ranges of the others with the line ends behind them, ``kept_sha256`` is of
    the bytes left. Lines are cut at ``\\n``; blank ones are not counted. Null texts are empty. Rows equal in id
    and text are one document that is listed as often; a text that repeats under another id loses all its chunks of
    that size. Empty tables give empty results; other columns are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = documents.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).alias("_id"), whole.alias("text"))
    named = named.withColumn("ref", F.xxhash64("id", "text"))
    again = named.select("text").mapInArrow(_keys, "key long").groupBy("key").agg(F.count("*").alias("n"))
    again = land(again.filter("n > 1").select("key"), "keys")
    # places without text are sorted out first; then texts that have any are read with them, once
    marks = named.select("ref", "text").mapInArrow(_placed, PLACED).join(again, "key").groupBy("ref")
    marks = marks.agg(F.collect_set(F.struct("key", "start", "size", "lines")).alias("chunks"))
    marked = named.select("ref", "id", F.col("text").cast("binary").alias("text")).join(marks, "ref")
    marked = land(marked.dropDuplicates(["ref"]), "marked")
    chunks = marked.select("ref", "id", "text", F.explode("chunks").alias("c")).select(
        "ref", "id", "c.*", F.expr("substring(text, c.start + 1, c.size)").alias("body")
    )
    # equal keys are not enough: chunks are equal when their bytes are
    place = F.struct("id", "ref", "start")
    firsts = chunks.groupBy("key", "body").agg(F.min(place).alias("first"))
    gone = chunks.join(firsts, ["key", "body"]).filter(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("ref").agg(F.collect_list(F.struct("start", "size", "lines")).alias("gone"))
    cut = marked.select("ref", "text").join(gone, "ref").mapInArrow(_cut, CUT)
    return _listed(named, cut, id_col)


def _lines(texts: list[bytes], bits: int) -> tuple[np.ndarray, ...]:
    """Lines of several texts that are not blank: text, first byte, byte behind the last, place in the text, key."""
    words = words_of(texts, _NOT_NEWLINE)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    per_doc = words.per_doc(len(texts))
    at = np.arange(len(words.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    return words.doc, words.start - first[words.doc], words.end - first[words.doc], at, words.key >> np.uint64(64 - bits)


def _line_pairs(texts: list[bytes], bits: int) -> tuple[np.ndarray, ...]:
    """Pairs of neighbouring lines: text, place of the first line, keys of both, key of the pair."""
    doc, _, _, at, key = _lines(texts, bits)
    i = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = key[i], key[i + 1]
    return doc[i], at[i], a.view(np.int64), b.view(np.int64), mixed(mixed(a) * _BASE + b).view(np.int64)


def remove_repeated_passages(documents: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The columns of ``remove_repeated_chunks`` for every row, without any repeated run of two or more lines.

    Of equal pairs of neighbouring lines the first stays: that of the least id (null first), then of the least place. A
    line goes when it is in any other pair; a pair that shares a line with the first one in its text stays too. A
    removed chunk is a longest run of lines that go. Lines are cut at ``\\n``; blank ones are not counted and do not
    part neighbours. Null texts are empty. Rows equal in id and text are one document that is listed as often. Empty
    tables give empty results; other columns are not read. Lines have keys of ``bits`` bits; those that share
    a key without being equal are told apart by their bytes.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = documents.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).alias("_id"), whole.alias("text"))
    named = named.withColumn("ref", F.xxhash64("id", "text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch, "text")
            for i, j in steps(texts):
                yield pa.RecordBatch.from_arrays([pa.array(_line_pairs(texts[i:j], bits)[-1])], names=["key"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, refs, ids = column_bytes(batch, "text"), batch.column("ref"), batch.column("id")
            for i, j in steps(texts):
                doc, at, a, b, key = _line_pairs(texts[i:j], bits)
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [refs.take(rows), ids.take(rows), pa.array(at.astype(np.int32)), *(pa.array(x) for x in (a, b, key))],
                    names=["ref", "id", "at", "a", "b", "key"],
                )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of the pairs in ``ats``."""
        for batch in batches:
            texts, refs, ats = column_bytes(batch, "text"), batch.column("ref").to_pylist(), batch.column("ats").to_pylist()
            for i, j in steps(texts):
                doc, start, end, at, key = _lines(texts[i:j], bits)
                first = np.searchsorted(doc, np.arange(j - i))
                of = [np.asarray(x, np.int64) + n for x, n in zip(ats[i:j], first)]
                which = np.unique(np.concatenate([x + k for x in of for k in (0, 1)]))
                d = (doc[which] + i).tolist()
                body = [texts[n][s:e] for n, s, e in zip(d, start[which].tolist(), end[which].tolist())]
                columns = [pa.array([refs[n] for n in d], pa.int64()), pa.array(at[which].astype(np.int32)),
                           pa.array(key[which].view(np.int64)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["ref", "at", "key", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = column_bytes(batch, "text"), batch.column("gone").to_pylist()
            runs: list[list[dict]] = []
            for i, j in steps(texts):
                doc, start, end, _, _ = _lines(texts[i:j], bits)
                first = np.searchsorted(doc, np.arange(j - i))
                for n, pairs in zip(first, gone[i:j]):
                    at = np.unique(np.concatenate([np.asarray(pairs, np.int64) + k for k in (0, 1)])) + n
                    edge = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                    last = np.append(edge[1:], len(at)) - 1
                    runs.append([{"start": int(start[at[x]]), "size": int(end[at[y]] - start[at[x]]), "lines": int(y - x + 1)}
                                 for x, y in zip(edge, last)] if len(at) else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("lines", pa.int32())]))
            columns = [batch.column("ref"), batch.column("text"), pa.array(runs, kind)]
            yield from _cut(iter([pa.RecordBatch.from_arrays(columns, names=["ref", "text", "gone"])]))

    def flagged(places: DataFrame) -> DataFrame:
        """Per text its pairs that occur more than once, and those of them that are not the first."""
        same = ["a", "b", "body"]
        firsts = places.groupBy(*same).agg(F.min(F.struct("id", "ref", "at")).alias("first"), F.count("*").alias("n"))
        near = (F.col("ref") == F.col("first.ref")) & (F.col("at") - F.col("first.at") < 2)
        found = places.join(firsts.filter("n > 1").drop("n"), same)
        return found.groupBy("ref").agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(~near, F.col("at"))).alias("gone"))

    def with_text(flags: DataFrame) -> DataFrame:
        texts = named.select("ref", F.col("text").cast("binary").alias("text"))
        return land(texts.join(flags, "ref").dropDuplicates(["ref"]), "marked")

    again = named.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n"))
    again = land(again.filter("n > 1").select("key"), "keys")
    places = named.select("ref", "id", "text").mapInArrow(placed, "ref long, id long, at int, a long, b long, key long")
    places = places.join(again, "key", "left_semi").drop("key").dropDuplicates(["ref", "at"])
    places = land(places.withColumn("body", F.lit(b"")), "places")
    marked = with_text(flagged(places))
    # equal keys are not enough: lines are equal when their bytes are
    lines = marked.select("ref", "text", "ats").mapInArrow(bodies, "ref long, at int, key long, body binary")
    shared = lines.groupBy("key").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    shared = land(shared.filter("least != most").select("key"), "shared")
    if not shared.isEmpty():
        named_lines = land(lines.join(shared, "key", "left_semi").select("ref", "at", "body"), "lines")
        one = named_lines.withColumnRenamed("body", "one")
        two = named_lines.select("ref", (F.col("at") - 1).alias("at"), F.col("body").alias("two"))
        places = places.drop("body").join(one, ["ref", "at"], "left").join(two, ["ref", "at"], "left")
        none, end = F.lit(b""), F.lit(b"\n")
        body = F.concat(F.coalesce("one", none), end, F.coalesce("two", none))
        marked = with_text(flagged(places.withColumn("body", body)))
    out = marked.filter(F.size("gone") > 0).select("ref", "text", "gone").mapInArrow(cut, CUT)
    return _listed(named, out, id_col)
