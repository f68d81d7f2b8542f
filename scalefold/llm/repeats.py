"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over the text triggers at its local minima; the 2 * RADIUS + WINDOW
bytes that decide a trigger are its *anchor*. Anchors cut every text into phrases
that depend on the text alone, so equal strings are cut alike wherever they are.
A string of LENGTH bytes belongs to the first anchor that starts in it, at a
distance of at most ROOM bytes; rare strings without one stand for themselves.

The dictionary counts, for every anchor text, its *blocks*: the phrase before
it and the LENGTH bytes after it start. One occurrence: all its strings are
unique. One block that occurs again: all are repeated. Only blocks that differ around an
equal anchor are left, at the ends of repeated passages. Their suffixes are sorted
into corpus order per anchor and neighbours compared byte by byte; anchors with many
blocks are refined instead: strings at a range of distances share more than the
anchor, and are counted by that longer text, in halves until all is decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalefold.llm.text import byte_values, column_bytes, mixed, ragged, steps
from scalefold.session import land

LENGTH = 200
WINDOW = 16
RADIUS = 24
CORE = 2 * RADIUS + WINDOW
ROOM = LENGTH - CORE
#: Blocks of one anchor text sorted in one group; above, they are refined.
GROUP = 64
#: Widths of the ranges of distances in which anchors with more blocks are refined.
WIDTHS = (32, 8, 1)
#: Bytes of texts parsed at once: few, so that what is worked out of them stays in the cache of a core.
_STEP = 1 << 17
_BASE = 0x9E3779B97F4A7C15


class Parse(NamedTuple):
    """Anchors of several texts, and strings without one; places count from the start of the text.

    Strings ``first .. last`` belong to ``anchor``; ``core`` and ``block`` are 64-bit keys."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    core: np.ndarray
    block: np.ndarray


def _whole(roll: np.ndarray, at: np.ndarray, size: int = CORE) -> np.ndarray:
    """Rolling hash of the ``size`` bytes from each place, put together from those of WINDOW bytes."""
    if size == WINDOW:
        return roll[at]
    half = size // 2
    return _whole(roll, at, half) * np.uint64(pow(_BASE, half, 1 << 64)) + _whole(roll, at + half, half)


def parse(texts: list[bytes]) -> Parse:
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts) + bytes(2 * LENGTH), np.uint8)
    roll, power = byte_values(1).take(data, mode="clip"), _BASE
    for k in (1, 2, 4, 8):
        h = roll[:-k] * np.uint64(power)
        h += roll[k:]
        roll, power = h, power * power % (1 << 64)
    least = roll
    for k in (1, 2, 4, 8, 8):  # over RADIUS places
        least = np.minimum(least[:-k], least[k:])
    n = len(least) - RADIUS - 1
    middle = roll[RADIUS : RADIUS + n]
    anchor = np.flatnonzero((middle < least[:n]) & (middle <= least[RADIUS + 1 : RADIUS + 1 + n]))
    end = begin + size
    doc = np.searchsorted(begin, anchor, side="right") - 1 if len(texts) else anchor
    whole_in = anchor + CORE <= end[doc]
    anchor, doc = anchor[whole_in], doc[whole_in]
    before = np.concatenate([[-1], anchor[:-1]])
    first = np.maximum(np.maximum(before + 1, begin[doc]), anchor - ROOM)
    last = np.minimum(anchor, end[doc] - LENGTH)
    some = first <= last
    anchor, doc, first, last = (x[some] for x in (anchor, doc, first, last))
    # strings that are in a text, but belong to no anchor
    long = size >= LENGTH
    gap = np.sort(np.concatenate([begin[long], last + 1]))
    alone = ragged(gap, np.sort(np.concatenate([end[long] - LENGTH + 1, first])) - gap)
    core = mixed(_whole(roll, anchor))
    stop = np.minimum(anchor + LENGTH, end[doc])
    block = mixed((anchor - first).astype(np.uint64) + np.uint64(1))
    for k in range(-(-(ROOM + LENGTH) // CORE)):
        at = np.minimum(first + k * CORE, stop - CORE)
        block = np.where(first + k * CORE < stop, mixed(block ^ _whole(roll, at)), block)
    own = np.full(len(alone), LENGTH, np.uint64)
    for k in (0, CORE, 2 * CORE, LENGTH - CORE):
        own = mixed(own ^ _whole(roll, alone + k))
    alone_doc = np.searchsorted(begin, alone, side="right") - 1 if len(alone) else alone
    # an empty text starts where the next one does: the last text that starts there is the one with bytes
    at = [np.concatenate([x, alone]) for x in (first, last, anchor)]
    doc = np.concatenate([doc, alone_doc])
    return Parse(doc, *(x - begin[doc] for x in at), np.concatenate([core, own]), np.concatenate([block, own]))


def _reference(id_col: str, text: str) -> Column:
    """Names a document by its id and text; rows equal in both share their fate."""
    return F.xxhash64(F.col(id_col), F.col(text))


def _anchors(documents: DataFrame, blocks: bool) -> DataFrame:
    """``(core, block)`` or ``(core, ref, anchor)`` of all texts."""
    names = ["core", "block"] if blocks else ["core", "ref", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch, "text")
            ref = None if blocks else batch.column("ref").to_numpy(zero_copy_only=False)
            for i, j in steps(texts, _STEP):
                p = parse(texts[i:j])
                rest = [p.block.view(np.int64)] if blocks else [ref[i:j][p.doc], p.anchor.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.core.view(np.int64), *rest)], names=names)

    kinds = "core long, block long" if blocks else "core long, ref long, anchor int"
    return documents.select("text", *([] if blocks else ["ref"])).mapInArrow(run, kinds)


def _classes(rows: DataFrame, group: int) -> DataFrame:
    """Cores that occur again: kind 1 in equal blocks only, 2 and 3 in different ones, up to ``group`` or more."""
    found = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("block").alias("a"), F.max("block").alias("b"))
    kind = F.when(F.col("a") == F.col("b"), 1).when(F.col("n") <= group, 2).otherwise(3)
    return found.filter("n > 1").select("core", kind.alias("kind"))


MARKED = (
    "ref long, n_bytes long, text binary, sure array<int>, "
    "blocks array<struct<kind int, core bigint, first int, left int, body binary>>"
)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the strings that are repeated for sure, as first, last, first, last ..., and undecided blocks."""
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("core", pa.int64()), ("first", pa.int32()),
                                ("left", pa.int32()), ("body", pa.binary())]))
    for batch in batches:
        texts, marks, refs = column_bytes(batch, "text"), batch.column("marks"), batch.column("ref").to_pylist()
        for i, j in steps(texts, _STEP):
            p = parse(texts[i:j])
            part = marks.slice(i, j - i)
            flat = part.flatten()
            doc = np.repeat(np.arange(j - i), np.diff(np.asarray(part.offsets)))
            at, kind = (np.asarray(x, dtype=np.int64) for x in flat.flatten())
            # find each mark's anchor: both by text, then place
            span = np.int64(max(map(len, texts[i:j])) + 1)
            order = np.argsort(p.doc * span + p.anchor)
            where = order[np.searchsorted((p.doc * span + p.anchor)[order], doc * span + at)]
            sure: list[list[int]] = [[] for _ in range(j - i)]
            blocks: list[list[dict]] = [[] for _ in range(j - i)]
            for d, w, k in zip(doc.tolist(), where.tolist(), kind.tolist()):
                first, last, anchor = int(p.first[w]), int(p.last[w]), int(p.anchor[w])
                if k == 1:
                    sure[d] += first, last
                else:
                    blocks[d].append({"kind": k, "core": int(p.core[w].view(np.int64)), "first": first,
                                      "left": anchor - first, "body": texts[i + d][first : anchor + LENGTH]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(refs[i:j], pa.int64()), pa.array([len(t) for t in texts[i:j]], pa.int64()),
                 pa.array(texts[i:j], pa.binary()), pa.array(sure, pa.list_(pa.int32())), pa.array(blocks, kinds)],
                names=["ref", "n_bytes", "text", "sure", "blocks"],
            )


def _runs(places: list[int]) -> list[int]:
    """first, last, first, last ... of the runs in rising places."""
    out: list[int] = []
    for x in places:
        if out and x == out[-1] + 1:
            out[-1] = x
        else:
            out += x, x
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks around one anchor text: their suffixes in corpus order; those whose first LENGTH bytes equal
    a neighbour's, and are of another place, are repeated."""
    for batch in batches:
        refs, n_bytes, sure = [], [], []
        for rows in batch.column("rows").to_pylist():
            bodies: dict[tuple[int, bytes], list[dict]] = {}
            for r in rows:
                bodies.setdefault((r["left"], r["body"]), []).append(r)
            kinds = list(bodies)
            suffixes = sorted(
                (body[k : k + LENGTH], i, k)
                for i, (left, body) in enumerate(kinds)
                for k in range(min(left, len(body) - LENGTH) + 1)
            )
            repeated: list[set[int]] = [set() for _ in kinds]
            for (a, i, k), (b, j, m) in zip(suffixes, suffixes[1:]):
                if a == b:
                    repeated[i].add(k)
                    repeated[j].add(m)
            for i, (left, body) in enumerate(kinds):
                own = bodies[left, body]
                places = range(min(left, len(body) - LENGTH) + 1) if len(own) > 1 else sorted(repeated[i])
                runs = _runs(list(places))
                for r in own if runs else ():
                    refs.append(r["ref"])
                    n_bytes.append(r["n_bytes"])
                    sure.append([r["first"] + x for x in runs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(refs, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(sure, pa.list_(pa.int32()))],
            names=["ref", "n_bytes", "sure"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks cut by the distance of their strings to the anchor, ``width`` distances at a time.

    Strings at distances p .. p + width - 1 share the p bytes before the anchor and
    LENGTH - p - width + 1 bytes from it: the core of the piece."""
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("ref", "n_bytes", "first", "left", "body", "low", "high", "core")]
        out: list[list] = [[] for _ in range(9)]
        for ref, size, first, left, body, low, high, core in zip(*rows):
            for p in range(low - low % width, high + 1, width):
                a, b = max(p, low), min(p + width - 1, high)
                shared = body[left - p : left + LENGTH - p - width + 1]
                block = body[left - b : left + LENGTH - a]
                values = (ref, size, first, left, body, a, b,
                          xxhash.xxh3_64_intdigest(shared, core & 0xFFFFFFFF ^ p << 32) - (1 << 63),
                          xxhash.xxh3_64_intdigest(block, a << 16 | b) - (1 << 63))
                for into, v in zip(out, values):
                    into.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(out, _PIECES_ARROW)], names=[f.name for f in _PIECES_ARROW]
        )


_PIECES_ARROW = pa.schema(
    [("ref", pa.int64()), ("n_bytes", pa.int64()), ("first", pa.int32()), ("left", pa.int32()), ("body", pa.binary()),
     ("low", pa.int32()), ("high", pa.int32()), ("core", pa.int64()), ("block", pa.int64())]
)
PIECES = "ref long, n_bytes long, first int, left int, body binary, low int, high int, core long, block long"


def _refined(blocks: DataFrame) -> DataFrame | None:
    """Repeated strings ``(ref, n_bytes, sure)`` of blocks around anchors that have many."""
    high = F.col("left")
    low = F.greatest(F.lit(0), F.col("left") + LENGTH - F.length("body"))
    rows, found = blocks.withColumns({"low": low, "high": high}), None
    for width in WIDTHS:
        pieces = land(rows.mapInArrow(lambda batches, width=width: _pieces(batches, width), PIECES), "pieces")
        if pieces.isEmpty():
            break
        kinds = _classes(pieces, 1)
        judged = land(pieces.join(kinds, "core").drop("block"), "judged")
        place = F.col("first") + F.col("left")
        sure = judged.filter("kind = 1").select("ref", "n_bytes", F.array(place - F.col("high"), place - F.col("low")).alias("sure"))
        found = sure if found is None else found.union(sure)
        rows = judged.filter("kind <> 1").drop("kind")
    return found


def _removal(size: int, sure: list[int]) -> np.ndarray:
    """Bytes covered by the strings that start at first .. last of each pair."""
    edges = np.zeros(size + 1, np.int64)
    pairs = np.array(sure, np.int64).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, np.minimum(pairs[:, 1] + LENGTH, size), -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column_bytes(batch, "text")
        out: list[list] = [[] for _ in range(4)]
        for text, sure in zip(texts, batch.column("sure").to_pylist()):
            gone = _removal(len(text), sure)
            turn = np.diff(gone.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = [{"start": s, "end": e} for s, e in zip(begin.tolist(), end.tolist())]
            for into, v in zip(out, (int(gone.sum()), len(begin), hashlib.sha256(kept).hexdigest(), spans)):
                into.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("ref"), batch.column("n_bytes"), *(pa.array(v, k) for v, k in zip(out, kinds))],
            names=["ref", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


CUT = "ref long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start bigint, end bigint>>"


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<id>, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for every row.

    A byte is removed when a string of LENGTH bytes over it starts anywhere else too, in this
    or in another text; strings never cross texts and overlaps count. ``spans`` are the
    maximal runs of removed bytes, ``kept_sha256`` is of the bytes left, in
    order. Null texts are empty; texts shorter than LENGTH lose nothing. A repeated
    row is another place for its text, so both lose it. Null ids and empty
    tables are allowed; other columns are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = documents.select(F.col(id_col).alias("_id"), whole.alias("text"))
    named = named.withColumn("ref", _reference("_id", "text"))
    kinds = land(_classes(_anchors(named, blocks=True), GROUP), "dictionary")
    found = _anchors(named, blocks=False).join(kinds, "core")
    marks = land(
        found.groupBy("ref").agg(F.collect_set(F.struct("anchor", "kind")).alias("marks")), "marks"
    )
    marked = named.select("ref", "text").join(marks, "ref").mapInArrow(_marked, MARKED)
    marked = land(marked, "marked")
    block = marked.select("ref", "n_bytes", F.explode("blocks").alias("b")).select("ref", "n_bytes", "b.*")
    few = block.filter("kind = 2").drop("kind").groupBy("core")
    sure = few.agg(F.collect_list(F.struct("ref", "n_bytes", "first", "left", "body")).alias("rows")).select("rows")
    sure = sure.mapInArrow(_sorted_groups, "ref long, n_bytes long, sure array<int>")
    refined = _refined(block.filter("kind = 3").drop("kind"))
    sure = sure if refined is None else sure.union(refined)
    more = sure.groupBy("ref", "n_bytes").agg(F.flatten(F.collect_list("sure")).alias("more"))
    none = F.array().cast("array<int>")
    cut = marked.select("ref", "n_bytes", "text", "sure").join(more, ["ref", "n_bytes"], "left")
    cut = cut.withColumn("sure", F.concat("sure", F.coalesce("more", none))).filter(F.size("sure") > 0)
    cut = cut.select("ref", "n_bytes", "text", "sure").mapInArrow(_cut, CUT).dropDuplicates(["ref", "n_bytes"])
    base = named.select("_id", "ref", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha"))
    out = base.join(cut, ["ref", "n_bytes"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start bigint, end bigint>>")).alias("spans"),
    )
