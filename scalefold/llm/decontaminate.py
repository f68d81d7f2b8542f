"""Benchmark decontamination by suffix arrays over shards of training text.

A task sorts the word suffixes of its documents (a shard), then looks up every
suffix of every benchmark item by binary search, one word deeper at a time: the
interval of the suffix array that still matches gives the longest verbatim match
and all its locations. A document lies in one shard, so its result is complete
where it is made and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalefold.llm.text import LETTERS_DIGITS, LOWER, Words, column_bytes, ragged, shipped, steps, tidied, unused, words_of
from scalefold.session import land

WINDOW = 10
#: Benchmark text sent to the tasks in one pass.
BLOCK_BYTES = 16 << 20
#: Text under one suffix array.
SHARD_BYTES = 4 << 20


@dataclass
class Items:
    """Benchmark items as word keys, one after another; ``item`` names are texts."""

    item: list[str | None]
    start: np.ndarray
    length: np.ndarray
    key: np.ndarray


def _words(texts: list[bytes]) -> Words:
    return words_of([t.translate(LOWER) for t in texts], LETTERS_DIGITS)


def _items(rows: list) -> Items:
    words = _words([(r.text or "").encode() for r in rows])
    length = words.per_doc(len(rows))
    return Items([r.item for r in rows], np.cumsum(length) - length, length, words.key)


def suffix_array(codes: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` (from 1 up) in the order of their suffixes, compared over ``depth`` codes or to the end of the text.

    ``room`` is the number of codes from a place to the end of its text. The
    first sort packs as many codes as fit 63 bits; then only suffixes still tied
    are sorted again, by the ranks found so far, over twice the depth each time.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    packed = np.zeros(n, np.int64)
    done = max(1, min(63 // bits, depth))
    for k in range(done):
        at = np.minimum(np.arange(n) + k, n - 1)
        packed = (packed << bits) | np.where(room > k, codes[at], 0)
    order = np.argsort(packed, kind="stable")
    fresh = np.concatenate([[True], packed[order][1:] != packed[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of a tie: its first place
    while done < depth:
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        after = np.where(room[at] > done, rank[np.minimum(at + done, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[at]))
        order[tied] = at[again]
        head, tail = rank[at][again], after[again]
        fresh[tied] = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        done *= 2
    return order


def _search(codes: np.ndarray, room: np.ndarray, order: np.ndarray, asked: np.ndarray, start: np.ndarray, most: np.ndarray):
    """For test suffixes ``asked[start:start + most]``: length of the longest match, and the
    interval of ``order`` that matches at that length (all of it where the length is 0)."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    length = np.zeros(len(start), np.int64)

    def bound(live: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """First place of each interval whose code at ``depth`` is at least ``want``."""
        a, b = low[live].copy(), high[live].copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            code = np.where(room[at] > depth, codes[np.minimum(at + depth, len(codes) - 1)], 0)
            less = open_ & (code < want)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a

    live = np.flatnonzero(most > 0) if len(order) else np.zeros(0, np.int64)
    while len(live):
        depth = int(length[live[0]])
        want = asked[start[live] + depth]
        a, b = bound(live, depth, want), bound(live, depth, want + 1)
        found = (a < b) & (want > 0)
        live, a, b = live[found], a[found], b[found]
        low[live], high[live] = a, b
        length[live] += 1
        live = live[length[live] < most[live]]
    return length, low, high


class Shard:
    """Words of some texts with the array of their suffixes, sorted over ``window`` words."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        words = _words(texts)
        self.doc, self.per_doc = words.doc, words.per_doc(len(texts))
        self.names, codes = np.unique(words.key, return_inverse=True)
        self.codes = codes.astype(np.int64) + 1
        ends = np.cumsum(self.per_doc)
        self.first = ends - self.per_doc
        self.room = ends[words.doc] - np.arange(len(codes))
        self.order = suffix_array(self.codes, self.room, window)

    def find(self, items: Items) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which words are hit; (text, item, words, at) of the longest match of an item in a text."""
        codes, room = self.codes, self.room
        if not len(codes) or not len(items.key):
            none = np.zeros(0, np.int64)
            return np.zeros(len(codes), bool), (none, none, none, none)
        at = np.minimum(np.searchsorted(self.names, items.key), len(self.names) - 1)
        asked = np.where(self.names[at] == items.key, at + 1, 0)
        owner = np.repeat(np.arange(len(items.length)), items.length)
        start = np.arange(len(items.key))
        most = np.repeat(items.start + items.length, items.length) - start
        needed = np.minimum(self.window, items.length)[owner]
        length, low, high = _search(codes, room, self.order, asked, start, np.minimum(most, needed))
        full = length == needed
        start, most, needed, owner, low, high = (x[full] for x in (start, most, needed, owner, low, high))
        count = high - low
        place = self.order[ragged(low, count)]
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, place, 1)
        np.add.at(edges, place + np.repeat(needed, count), -1)
        # how far each occurrence of a window goes on, word by word
        goes, limit = np.repeat(needed, count), np.minimum(np.repeat(most, count), room[place])
        source, owner = np.repeat(start, count), np.repeat(owner, count)
        live = np.flatnonzero(goes < limit)
        while len(live):
            live = live[codes[place[live] + goes[live]] == asked[source[live] + goes[live]]]
            goes[live] += 1
            live = live[goes[live] < limit[live]]
        doc = self.doc[place]
        best = np.lexsort((place, -goes, owner, doc))
        doc, owner, goes, place = doc[best], owner[best], goes[best], place[best]
        lead = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        return np.cumsum(edges[:-1]) > 0, (doc[lead], owner[lead], goes[lead], place[lead] - self.first[doc[lead]])

    def spans(self, hit: np.ndarray) -> list[list[dict]]:
        """Runs of hit words of each text as word positions, ends excluded."""
        turn = np.diff(self.doc, prepend=-1) != 0
        begin = np.flatnonzero(hit & (turn | ~np.concatenate([[False], hit[:-1]])))
        end = np.flatnonzero(hit & np.concatenate([turn[1:] | ~hit[1:], [True]])) + 1
        out: list[list[dict]] = [[] for _ in self.per_doc]
        doc = self.doc[begin]
        for d, s, e in zip(doc.tolist(), (begin - self.first[doc]).tolist(), (end - self.first[doc]).tolist()):
            out[d].append({"start": s, "end": e})
        return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ITEMS = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int64()), ("at", pa.int64())]))
FOUND = "n_words long, spans array<struct<start bigint, end bigint>>, items array<struct<item string, words bigint, at bigint>>"


def _by_name(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _pass(documents: DataFrame, keep: list[str], block: list, window: int, text: str) -> DataFrame:
    """One pass over the documents with one block of items."""
    held = shipped(documents.sparkSession, _items(block))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held()
        for batch in batches:
            texts = column_bytes(batch, text)
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list[dict]] = []
            found: list[dict[str, tuple[int, int]]] = [{} for _ in texts]
            for i, j in steps(texts, SHARD_BYTES):
                shard = Shard(texts[i:j], window)
                hit, pairs = shard.find(asked)
                n_words[i:j] = shard.per_doc
                spans += shard.spans(hit)
                for doc, owner, goes, at in zip(*(x.tolist() for x in pairs)):
                    own, name = found[i + doc], asked.item[owner]
                    own[name] = min(own.get(name, (0, 0)), (-goes, at))
            rows = [[{"item": k, "words": -own[k][0], "at": own[k][1]} for k in sorted(own, key=_by_name)] for own in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n_words), pa.array(spans, SPANS), pa.array(rows, ITEMS)],
                names=[*keep, "n_words", "spans", "items"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*keep).schema)
    return documents.mapInArrow(tidied(look_up), kinds + FOUND)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of spans and of items of several passes."""
    for batch in batches:
        spans, items = [], []
        for some in batch.column("spans").to_pylist():
            out: list[dict] = []
            for s in sorted(some, key=lambda s: s["start"]):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            spans.append(out)
        for some in batch.column("items").to_pylist():
            best = sorted(some, key=lambda x: (_by_name(x["item"]), -x["words"], x["at"]))
            items.append([x for k, x in enumerate(best) if not k or best[k - 1]["item"] != x["item"]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("n_words"), pa.array(spans, SPANS), pa.array(items, ITEMS)],
            names=["_row", "n_words", "spans", "items"],
        )


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document row with what it shares with the benchmark.

    Adds ``n_words``, ``spans`` (runs of words inside occurrences of a window of
    ``window`` consecutive item words; a shorter item is one window), ``items``
    (``(item, words, at)`` by item: longest verbatim match in words and the word
    it starts at; ties the first place), ``n_hit`` (words in spans) and
    ``contaminated``. A-Z are lowered, words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts have no words, items
    without words match nothing, an empty benchmark hits nothing. Repeated
    rows are matched alike; repeated item ids are listed once. Items without an id count as one item
    whose ``item`` is null, listed last.

    A benchmark of up to ``block_bytes`` of text is broadcast. A larger one is
    dealt into blocks of about that size by a hash of the item, one pass over the
    landed documents for each, and the findings are united by row.
    """
    added = ("n_words", "spans", "items", "n_hit", "contaminated")
    keep = [c for c in (documents.columns if carry is None else carry) if c not in added]
    asked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    own, number = unused(documents, "_text"), unused(documents, "_row")
    if blocks <= 1:
        found = _pass(documents.select(*keep, F.col(text).alias(own)), keep, asked.collect(), window, own)
    else:
        rows = land(documents.select(*keep, F.col(text).alias(own), F.monotonically_increasing_id().alias(number)), "rows")
        found = None
        for k in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
            part = land(_pass(rows.select(F.col(number).alias("_row"), own), ["_row"], block, window, own), "matches")
            found = part if found is None else found.union(part)
        found = (
            found.groupBy("_row")
            .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                 F.flatten(F.collect_list("items")).alias("items"))
            .mapInArrow(_joined, "_row long, " + FOUND)
        )
        found = rows.drop(own).join(found.withColumnRenamed("_row", number), number).drop(number)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
