"""Scoring texts with an n-gram language model kept as Elias-Fano tries.

Every word, pair and triple of words of the training texts counts; no order has a
bounded vocabulary. A word's own probability is (c + 1) / (N + V + 1), and

    p(w | h) = max(c(hw) - D, 0) / c(h) + D t(h) / c(h) p(w | h without its first word)

with t(h) the number of different words seen after h. A text begins after one end mark, so its
first word has a history of one and all others of two.

All that p(w | u v) asks of pairs and triples lies with the contexts (v) and (u v), so tokens are
dealt by v. A shard counts its tokens, builds its trie from those of training texts,
looks up all its tokens there and passes on one sum a text. The tries are as many as
the tokens need and none is broadcast or collected. A word v with more than ``HOT`` tokens is
spread by u over several shards; each of them is given the summed pairs of v.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalefold.llm.eliasfano import Level, from_buffer, to_bytes
from scalefold.llm.text import LOWER, NOT_SPACE, column_bytes, mixed, shipped, steps, tidied, unused, words_of
from scalefold.session import land

DISCOUNT = 0.75
#: Tokens of a shard, on average.
SHARD_TOKENS = 1 << 21
#: A context with more tokens than this, and more than one in HOT_SHARE of all, is spread over shards;
#: so at most HOT_SHARE words are sent to the tasks that deal tokens out.
HOT = 1 << 20
HOT_SHARE = 1 << 20
#: Counts of at most so many of the most frequent words are broadcast.
KNOWN_WORDS = 1 << 19
#: The key of the end of a text.
END = np.uint64(0)
#: Rows a task gathers before it adds them up.
_FLUSH = 1 << 22


class _Tokens:
    """Words and ends of several texts in order: text, key, place in the text."""

    def __init__(self, texts: list[bytes]):
        words = words_of([t.translate(LOWER) for t in texts], NOT_SPACE)
        per_doc = words.per_doc(len(texts))
        self.n = per_doc + 1
        ends = np.cumsum(self.n) - 1
        self.key = np.full(len(words.key) + len(texts), END, np.uint64)
        inner = np.ones(len(self.key), bool)
        inner[ends] = False
        self.key[inner] = words.key
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.first = np.zeros(len(self.key), bool)
        self.first[ends - per_doc] = True


class _Gather:
    """Counts of keys, added up as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        keys, inverse = np.unique(codes, return_inverse=True)
        self.parts.append((keys, np.bincount(inverse, n, minlength=len(keys)).astype(np.int64)))
        self.size += len(keys)
        if self.size > _FLUSH:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys = np.concatenate([p[0] for p in self.parts])
            n = np.concatenate([p[1] for p in self.parts])
            keys, inverse = np.unique(keys, return_inverse=True)
            self.parts = [(keys, np.bincount(inverse, n, minlength=len(keys)).astype(np.int64))]
        self.size = sum(len(p[0]) for p in self.parts)
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of the tokens of rows ``(text, weight)``; ``word`` is the 64-bit key of the word, 0 the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Gather()
        for batch in batches:
            texts, weight = column_bytes(batch, "text"), batch.column("weight").to_numpy()
            for i, j in steps(texts):
                tokens = _Tokens(texts[i:j])
                seen.add(tokens.key, weight[i:j][tokens.doc])
        keys, n = seen.total()
        yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n)], names=["word", "n"])

    rows = texts.filter("weight > 0").select("text", "weight").mapInArrow(tidied(count), "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _known(keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ``words``, and the counts of those; 0 for the others."""
    if not len(words):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    there = words[at] == keys
    return there, np.where(there, counts[at], 0)


class _Deal:
    """The shard of a token by its context: words with many tokens are spread by the word before, text starts by the word itself."""

    def __init__(self, shards: int, hot: np.ndarray, ways: np.ndarray):
        order = np.argsort(hot)
        self.shards, self.hot, self.ways = shards, hot[order], ways[order]

    def way(self, v: np.ndarray) -> np.ndarray:
        """Over how many shards each word is spread."""
        if not len(self.hot):
            return np.ones(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return np.where(self.hot[at] == v, self.ways[at], 1)

    def __call__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        salt = mixed(np.where(v == END, w, u) + np.uint64(1)) % self.way(v).astype(np.uint64)
        return ((mixed(v + np.uint64(2)) + salt) % np.uint64(self.shards)).astype(np.int64)

    def all_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every shard that holds tokens after each word: row numbers, shards."""
        ways = np.minimum(self.way(v), self.shards)
        row = np.repeat(np.arange(len(v)), ways)
        salt = (np.arange(len(row)) - np.repeat(np.cumsum(ways) - ways, ways)).astype(np.uint64)
        return row, ((mixed(v + np.uint64(2))[row] + salt) % np.uint64(self.shards)).astype(np.int64)


def _least(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _ordered(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by (v, u, w), all below n, and which of them in that order differ from the one before."""
    if n < 1 << 21:
        code = (v.astype(np.int64) * n + u) * n + w
        order = np.argsort(code)
        fresh = np.diff(code[order], prepend=-1) != 0
        # equal tokens in the order they came in, by a sort of plain numbers: much faster than a stable one
        bits = max(len(code) - 1, 0).bit_length()
        if 2 * bits < 63:
            order = np.sort((np.cumsum(fresh) - 1 << bits) + order) & (1 << bits) - 1
            return order, fresh
        order = np.argsort(code, kind="stable")
        return order, fresh
    order = np.lexsort((w, u, v))
    return order, np.logical_or.reduce([np.diff(x[order].astype(np.int64), prepend=-1) != 0 for x in (v, u, w)])


def _used(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers among ``x``, all below ``n``, and the place of each there; many are marked, not sorted."""
    if len(x) < n >> 3:
        return np.unique(x, return_inverse=True)
    there = np.zeros(n, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _planes(x: np.ndarray) -> np.ndarray:
    """Low bytes of all numbers, then their next bytes and so on: planes compress better than numbers."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.ravel()


def _whole(planes: np.ndarray, n: int) -> np.ndarray:
    size = len(planes) // n
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"u{size}").ravel()


def _rises(x: np.ndarray) -> np.ndarray:
    """Planes of the steps of a sorted sequence."""
    return _planes(_least(np.diff(x, prepend=x.dtype.type(0))))


def _pack(number: np.ndarray, weight: np.ndarray, texts: list[bytes], deal: _Deal, words: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Tokens of several texts as one byte string a shard, sorted by (v, u, w).

    It holds how many tokens, named words and texts there are; the words, known ones by their places among
    ``words``; v, u and w as numbers of these; text, how often, how often in training; the texts' numbers.
    """
    tokens = _Tokens(texts)
    names, w = np.unique(tokens.key, return_inverse=True)  # the end of a text is the smallest key
    second = np.concatenate([[True], tokens.first[:-1]])
    v = np.where(tokens.first, 0, np.concatenate([[0], w[:-1]]))
    u = np.where(tokens.first | second, 0, np.concatenate([[0, 0], w[:-2]])[: len(w)])
    order, fresh = _ordered(v, u, w, len(names))
    doc = tokens.doc[order]
    start = np.flatnonzero(fresh | (np.diff(doc, prepend=-1) != 0))
    times, doc, order = np.diff(np.append(start, len(order))), doc[start], order[start]
    v, u, w = v[order], u[order], w[order]
    shard = deal(names[v], names[u], names[w])
    by_shard = np.argsort(_least(shard), kind="stable")
    place_of = np.full(len(names), -1, np.int64)
    if len(words):
        near = np.minimum(np.searchsorted(words, names), len(words) - 1)
        place_of = np.where(words[near] == names, near, -1)
    edge = np.flatnonzero(np.diff(shard[by_shard], prepend=-1))
    for s, e in zip(edge, np.append(edge[1:], len(by_shard))):
        at = by_shard[s:e]
        used, local = _used(np.concatenate([v[at], u[at], w[at]]), len(names))
        own_v, own_u, own_w = np.split(local, 3)
        place = place_of[used]
        rest, placed = names[used][place < 0], place[place >= 0]
        docs, own_doc = _used(doc[at], len(texts))
        # u rises as long as v stays, so its steps are small but where v changes
        turn = np.diff(own_v, prepend=-1) != 0
        step = np.where(turn, own_u, np.diff(own_u, prepend=0))
        raw = to_bytes(
            [np.array([len(at), len(rest), len(placed), len(docs)], np.int64), rest, _rises(placed), _rises(own_v), _planes(_least(step)),
             _planes(_least(own_w)), _planes(_least(own_doc)), _planes(_least(times[at])), _planes(_least(times[at] * weight[doc[at]])),
             _rises(number[docs])]
        )
        yield int(shard[at[0]]), np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, then for each token v, u and w as numbers of these, the number of its text, how often, how often in training."""
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    (n, _, named, docs), rest, *planes = from_buffer(np.frombuffer(raw, np.uint8))
    placed = np.cumsum(_whole(planes[0], named), dtype=np.int64) if named else np.zeros(0, np.int64)
    v, step, w, doc, times, learned = (_whole(p, n).astype(np.int64) for p in planes[1:7])
    v = np.cumsum(v)
    u = np.cumsum(step)
    start = np.flatnonzero(np.diff(v, prepend=-1) != 0)
    u -= np.repeat(u[start] - step[start], np.diff(np.append(start, n)))
    number = np.cumsum(_whole(planes[7], docs), dtype=np.int64)
    return np.sort(np.concatenate([words[placed], rest])), v, u, w, number[doc], times, learned


def _grams(texts: DataFrame, deal, known) -> DataFrame:
    """``(shard, blob)``: all tokens with their histories, packed by shard."""

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, words = deal(), known()[0]
        for batch in batches:
            texts = column_bytes(batch, "text")
            number, weight = batch.column("number").to_numpy(), batch.column("weight").to_numpy()
            for i, j in steps(texts):
                rows = list(_pack(number[i:j], weight[i:j], texts[i:j], dealt, words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"]
                )

    return texts.select("text", "number", "weight").mapInArrow(tidied(deal_out), "shard long, blob binary")


def _hot_pairs(texts: DataFrame, deal) -> DataFrame:
    """``(shard, v, w, n)``: the summed pairs of every hot word, once for each shard that holds tokens after it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = deal().hot
        for batch in batches:
            texts, weight = column_bytes(batch, "text"), batch.column("weight").to_numpy()
            for i, j in steps(texts):
                tokens = _Tokens(texts[i:j])
                v = np.where(tokens.first, END, np.concatenate([[END], tokens.key[:-1]]))
                at = np.flatnonzero(np.isin(v, hot))
                names, w = np.unique(tokens.key[at], return_inverse=True)
                codes, inverse = np.unique(np.searchsorted(hot, v[at]) * max(len(names), 1) + w, return_inverse=True)
                n = np.bincount(inverse, weight[i:j][tokens.doc[at]], minlength=len(codes)).astype(np.int64)
                which, w = np.divmod(codes, max(len(names), 1))
                yield pa.RecordBatch.from_arrays([_signed(hot[which]), _signed(names[w]), pa.array(n)], names=["v", "w", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = deal()
        for batch in batches:
            row, shard = dealt.all_of(_unsigned(batch.column("v")))
            take = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *take.columns], names=["shard", "v", "w", "n"])

    pairs = texts.filter("weight > 0").select("text", "weight").mapInArrow(tidied(count), "v long, w long, n long")
    summed = pairs.groupBy("v", "w").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(spread, "shard long, v long, w long, n long")


def _smoothed(context: np.ndarray, n: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of counts n and the weight each context leaves to shorter ones."""
    total = np.bincount(context, n, minlength=contexts)
    kinds = np.bincount(context, minlength=contexts)
    left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return (n - DISCOUNT) / total[context], left


def _mapped(blobs: list[bytes]) -> list[Level]:
    """Levels in a memory-mapped file without a name, which goes with the task."""
    with tempfile.TemporaryFile() as file:
        file.write(b"".join(blobs))
        file.flush()
        whole = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    ends = np.cumsum([len(b) for b in blobs])
    return [Level(from_buffer(whole[e - len(b) : e])) for b, e in zip(blobs, ends)]


class Trie:
    """Pairs and triples of one shard: ``pairs`` (v, w), ``before`` (v, u), whose places are the
    contexts of ``triples``. Words are numbers below ``words``; triples come sorted by (v, u, w)."""

    def __init__(self, words: int, pair: tuple[np.ndarray, ...], triple: tuple[np.ndarray, ...]):
        v, w, n = pair
        share, left = _smoothed(v, n, words)
        blobs = [Level.build(0, words, words, v, w, share, left)]
        v, u, w, n = triple
        fresh = (np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0)
        context = np.cumsum(fresh) - 1
        v, u = v[fresh], u[fresh]
        share, left = _smoothed(context, n, len(v))
        blobs += [Level.build(0, words, words, v, u, np.ones(len(v)), np.ones(words)),
                  Level.build(0, len(v), words, context, w, share, left)]
        self.pairs, self.before, self.triples = _mapped(blobs)

    def parts(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``a`` and ``b`` such that p(w | u v) = a + b p(w), for tokens sorted by (v, u, w)."""
        words = self.pairs.words
        codes, inverse = np.unique(v * words + w, return_inverse=True)
        found, left = self.pairs.find(*np.divmod(codes, words))
        a, b = np.where(np.isnan(found), 0, 10.0**found)[inverse], (10.0**left)[inverse]
        fresh = (np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0)
        context = self.before.place(v[fresh], u[fresh])[np.cumsum(fresh) - 1]
        at = np.flatnonzero(context >= 0)
        found, left = self.triples.find(context[at], w[at])
        left = 10.0**left
        a[at] = np.where(np.isnan(found), 0, 10.0**found) + left * a[at]
        b[at] *= left
        return a, b


def _scored_shard(blobs: list[bytes], hot: tuple[np.ndarray, ...], dealt: _Deal, known, rest: float) -> tuple[tuple, tuple]:
    """Sums ``(text, log10)`` of one shard, and of words without a known count ``(text, word, times, a, b)``."""
    words, counts = known
    parts = [_unpack(b, words) for b in blobs]
    names = np.sort(np.concatenate([*(p[0] for p in parts), *hot[:2], [END]]).astype(np.uint64))
    names = names[np.append(True, names[1:] != names[:-1])]
    local = [np.searchsorted(names, p[0]).astype(np.int32) for p in parts]
    v, u, w = (np.concatenate([own[p[i]] for own, p in zip(local, parts)]) for i in (1, 2, 3))
    text, times, learned = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    del parts, local
    order, fresh = _ordered(v, u, w, len(names))
    start = np.flatnonzero(fresh)
    gram = np.cumsum(fresh) - 1
    text, times = text[order], times[order]
    n = np.add.reduceat(learned[order], start)
    v, u, w = (x[order][start].astype(np.int64) for x in (v, u, w))
    own = (n > 0) & (dealt.way(names)[v] == 1)  # pairs of spread words come summed over their shards
    codes, inverse = np.unique(v[own] * len(names) + w[own], return_inverse=True)
    codes = np.concatenate([codes, np.searchsorted(names, hot[0]) * len(names) + np.searchsorted(names, hot[1])])
    count = np.concatenate([np.bincount(inverse, n[own]), hot[2]])
    by_code = np.argsort(codes)
    inner = (n > 0) & (names[v] != END)
    trie = Trie(len(names), (*np.divmod(codes[by_code], len(names)), count[by_code]), (v[inner], u[inner], w[inner], n[inner]))
    a, b = trie.parts(v, u, w)
    key = names[w]
    common, count = (x[w] for x in _known(names, words, counts))
    alone = (count + 1) * 10.0**-rest
    value, common = np.log10(a + b * alone)[gram], common[gram]
    texts, inverse = np.unique(text[common], return_inverse=True)
    sums = np.bincount(inverse, (value[common] * times[common]), minlength=len(texts))
    rare = np.flatnonzero(~common)
    return (texts, sums), (text[rare], key[gram[rare]], times[rare], a[gram[rare]], b[gram[rare]])


def _distinct_texts(documents: DataFrame, text: str, training: Column, keep: list[str]) -> DataFrame:
    """Landed rows: ``keep``, ``number``, ``text``, ``weight``, ``same``.

    Of equal texts that a task meets together the first stands for all: ``same`` is its ``number``, its
    ``weight`` the training rows among them; the others have no text.
    """
    hidden, flag, number, weight, same = (unused(documents, c) for c in ("_text", "_train", "_row", "_weight", "_same"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, train = column_bytes(batch, hidden), batch.column(flag).to_numpy(zero_copy_only=False)
            first: dict[bytes, int] = {}
            own = np.array([first.setdefault(t, i) for i, t in enumerate(texts)], np.int64)
            rows = batch.column(number).to_numpy()
            is_first = own == np.arange(len(own))
            weights = np.bincount(own, train, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), batch.column(number),
                 pa.array([t if f else None for t, f in zip(texts, is_first)], pa.binary()), pa.array(weights), pa.array(rows[own])],
                names=[*keep, number, hidden, weight, same],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*keep).schema)
    kinds += f"`{number}` long, `{hidden}` binary, `{weight}` long, `{same}` long"
    rows = documents.select(
        *keep, F.col(text).alias(hidden), F.coalesce(training, F.lit(False)).alias(flag), F.monotonically_increasing_id().alias(number)
    )
    landed = land(rows.mapInArrow(tidied(collapse), kinds), "texts", "zstd")
    return landed.select(F.struct(*keep).alias("kept"), *(F.col(c).alias(n) for c, n in
                         ((number, "number"), (hidden, "text"), (weight, "weight"), (same, "same"))))


def score(documents: DataFrame, training: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` under the model of the ``training`` rows.

    ``base_score`` sums log10((c + 1) / (N + V + 1)) over the words of the text and its end, ``score`` the
    model's log10. A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``; null, empty and word-free
    texts are their end alone. Rows where ``training`` is null or false are only scored; without a training row the
    model knows no word and gives each 1. Repeated rows score alike; other columns (or those in ``carry``)
    pass through. To score one table by another, unite them with a column that tells them apart.
    """
    spark = documents.sparkSession
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (documents.columns if carry is None else carry) if c not in added]
    rows = _distinct_texts(documents, text, training, keep)
    texts = rows.filter("text is not null").select("number", "text", "weight")
    counts = land(word_counts(texts), "words")
    tokens, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    rest = float(np.log10(tokens + distinct + 1))

    # frequent words: as many steps of falling counts as KNOWN_WORDS allow
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if held + r["count"] > KNOWN_WORDS:
            break
        least, held = r["step"], held + r["count"]
    frequent = counts.filter(step >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    frequent = frequent.assign(word=frequent["word"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("word")
    known = shipped(spark, (frequent["word"].to_numpy(), frequent["n"].to_numpy(dtype=np.int64)))
    # contexts with many tokens, fewer than HOT_SHARE
    much = max(HOT, tokens // HOT_SHARE)
    hot = counts.filter(F.col("n") > much).toPandas()
    dealt = _Deal(max(1, -(-tokens // SHARD_TOKENS)), hot["word"].to_numpy(dtype=np.int64).view(np.uint64), -(-hot["n"].to_numpy(dtype=np.int64) // much))
    deal = shipped(spark, dealt)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = known()
        for batch in batches:
            texts = column_bytes(batch, "text")
            out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(3)]
            for i, j in steps(texts):
                tokens = _Tokens(texts[i:j])
                names, place = np.unique(tokens.key, return_inverse=True)
                common, count = _known(names, words, n)
                common, alone = common[place], (np.log10(count + 1.0) - rest)[place]
                for into, x in zip(out, (tokens.n, *(np.bincount(tokens.doc, x, minlength=j - i) for x in (common, alone)))):
                    into.append(x)
            flat = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), *(pa.array(x.astype(np.int64)) for x in flat[:2]), pa.array(flat[2])],
                names=["number", "n_tokens", "n_known", "base"],
            )

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [bytes(b) for b in table.column("blob").to_pylist() if b is not None]
        pairs = table.filter(pc.is_null(table.column("blob")))
        if not blobs:
            return empty.empty_table()
        sent = _unsigned(pairs.column("v")), _unsigned(pairs.column("w")), pairs.column("n").to_numpy()
        (text, sums), (rare, word, times, a, b) = _scored_shard(blobs, sent, deal(), known(), rest)
        n, m = len(text), len(rare)
        return pa.table({
            "number": pa.array(np.concatenate([text, rare]).astype(np.int64)), "score": pa.array(np.concatenate([sums, np.zeros(m)])),
            "word": pa.concat_arrays([pa.nulls(n, pa.int64()), _signed(word)]),
            "times": pa.array(np.concatenate([np.zeros(n, np.int64), times])),
            **{k: pa.array(np.concatenate([np.zeros(n), x]).astype(np.float32)) for k, x in (("a", a), ("b", b))},
        }, schema=empty)

    empty = pa.schema([("number", pa.int64()), ("score", pa.float64()), ("word", pa.int64()), ("times", pa.int64()),
                       ("a", pa.float32()), ("b", pa.float32())])
    none = F.lit(None).cast("long")
    dealt_out = _grams(texts, deal, known).select("shard", "blob", none.alias("v"), none.alias("w"), none.alias("n"))
    if len(hot):
        dealt_out = dealt_out.unionByName(_hot_pairs(texts, deal).select("shard", F.lit(None).cast("binary").alias("blob"), "v", "w", "n"))
    answers = land(
        dealt_out.groupBy("shard").applyInArrow(shard, "number long, score double, word long, times long, a float, b float"), "answers", "zstd"
    )
    # words whose counts were not broadcast take them from the table
    rare = answers.filter("word is not null").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.select(
        "number", (F.col("times") * F.log10(F.col("a") + F.col("b") * (n + 1) * F.lit(10.0**-rest))).alias("score"),
        (F.col("times") * F.log10(n + 1.0)).alias("base"), F.when(n > 0, F.col("times")).otherwise(0).alias("n_known"),
    )
    zero = F.lit(0).cast("long")
    sums = answers.filter("word is null").select("number", "score", F.lit(0.0).alias("base"), zero.alias("n_known"), zero.alias("n_tokens"))
    sums = sums.unionByName(rare.withColumn("n_tokens", zero)).unionByName(
        texts.select("number", "text").mapInArrow(tidied(of_words), "number long, n_tokens long, n_known long, base double").withColumn("score", F.lit(0.0))
    )
    sums = sums.groupBy("number").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return rows.select("kept", "same").join(sums, F.col("same") == F.col("number")).select(
        *(F.col("kept").getField(c).alias(c) for c in keep), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
