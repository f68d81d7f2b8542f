"""Token ids of a corpus as compressed files: an adaptive context-mixing range coder.

A *block* holds up to BLOCK_IDS ids: model and coder start anew in it, and a
crc32 of its ids is checked when it is read. A *frame*, one row of the file, holds
whole documents in the order of their ids: the counts of their ids, the ids' blocks
and the lengths of the documents.

An id is coded in one step. Its share is added up from how often it comes in the frame
(order 0), whether it came after the same previous id last (order 1) and after the same two
ids (order 2); a context that was right more often weighs more, one that was never
seen adds nothing. If a longer context names the id, its part of order 0 is left out. The shares drive a carry-less range
coder. Python would be slow for one block, so the blocks of a frame run side by side, as one array step per id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scalefold.llm.text import column_bytes, few_rows, steps, tidied

BLOCK_IDS = 2048
#: Blocks coded side by side.
LANES = 4096
FRAME_IDS = BLOCK_IDS * LANES
# All shares of a step add up to 2**29: of 2**12 parts the guesses get theirs, and order 0 divides the rest into 2**17.
_PARTS_BITS, _COUNT_BITS = 12, 17
_PARTS_ALL, _COUNT_ALL = 1 << _PARTS_BITS, 1 << _COUNT_BITS
_ALL_BITS = np.uint64(_PARTS_BITS + _COUNT_BITS)
# Guesses a block remembers for orders 1 and 2, by a hash of the context: the id that came plus 1, above three bits that tell how often it was right.
_SLOT_BITS = (8, 9)
_SHARES = (np.array([0, 40, 120, 250, 400, 600, 900, 1400], np.uint32), np.array([0, 100, 300, 600, 900, 1300, 1700, 2200], np.uint32))
# How the three bits change, for 0 to 7 first after a wrong guess and then after a right one; below 2 a wrong guess is replaced.
_STEP = np.array([0, 0, -1, -1, -2, -2, -3, -3, 0, 1, 1, 1, 1, 1, 1, 0]).astype(np.uint32)
_COUNT_SHIFT, _HASH, _ZERO = np.uint32(_COUNT_BITS), np.uint32(0x9E3779B1), np.uint32(0)
_WORD, _HALF = np.uint64(32), np.uint64(1 << 32)


class _Counts:
    """Order 0: how often each id comes in a frame, as shares of 2**17 that are at least 1."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        self.of = np.zeros(1 << 16, np.uint32)
        self.of[ids] = share
        self.below = np.zeros(1 << 16, np.uint32)
        self.below[ids] = np.cumsum(share) - share
        self.at = np.repeat(ids.astype(np.uint16), share)

    @classmethod
    def measured(cls, ids: np.ndarray) -> _Counts:
        counts = np.bincount(ids, minlength=1)
        found = np.flatnonzero(counts)
        share = 1 + counts[found] * (_COUNT_ALL - len(found)) // len(ids)
        share[share.argmax()] += _COUNT_ALL - share.sum()
        return cls(found, share)

    def packed(self) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u2").tobytes()
        return zlib.compress(steps + self.share.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, packed: bytes) -> _Counts:
        try:
            plain = zlib.decompress(packed)
        except zlib.error as e:
            raise ValueError("the counts of a frame of token ids cannot be read") from e
        n = len(plain) // 6
        ids, share = np.cumsum(np.frombuffer(plain, "<u2", n), dtype=np.int64), np.frombuffer(plain, "<u4", n, 2 * n).astype(np.int64)
        if not n or len(plain) != 6 * n or ids[-1] >= 1 << 16 or share.sum() != _COUNT_ALL:
            raise ValueError("the counts of a frame of token ids cannot be read")
        return cls(ids, share)


class _Model:
    """Shares of the next id in many blocks, added up from orders 0, 1 and 2."""

    def __init__(self, lanes: int, counts: _Counts):
        self.counts = counts
        self.slots = [np.zeros(lanes << bits, np.uint32) for bits in _SLOT_BITS]
        self.lane = [np.arange(lanes) << bits for bits in _SLOT_BITS]
        self.one = np.zeros(lanes, np.uint32)
        self.two = np.zeros(lanes, np.uint32)

    def guess(self, live: int) -> None:
        """Look up what followed the last id and the last two ids, and the parts of each."""
        contexts = self.one[:live], self.two[:live]
        self.at = [lane[:live] + (c * _HASH >> np.uint32(32 - bits)) for lane, c, bits in zip(self.lane, contexts, _SLOT_BITS)]
        self.slot = [slots.take(at) for slots, at in zip(self.slots, self.at)]
        self.sure = [slot & np.uint32(7) for slot in self.slot]
        self.key = [slot >> np.uint32(3) for slot in self.slot]
        self.parts = [shares.take(sure) for shares, sure in zip(_SHARES, self.sure)]
        base = self.parts[0] + self.parts[1]
        self.base, self.rest = base << _COUNT_SHIFT, np.uint32(_PARTS_ALL) - base

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the places; order 2 lies first, then order 1, then order 0."""
        ids = self.counts.at.take((np.maximum(place, self.base) - self.base) // self.rest).astype(np.uint32)
        guessed = np.flatnonzero(place < self.base)
        second = place[guessed] >> _COUNT_SHIFT < self.parts[1][guessed]
        ids[guessed] = np.where(second, self.key[1][guessed], self.key[0][guessed]) - np.uint32(1)
        return ids

    def shares(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of the ids begin, and the shares; the guesses learn from the ids."""
        key = ids + np.uint32(1)
        one, two = ((k == key).astype(np.uint32) for k in self.key)
        known = _ZERO - (one | two)  # all bits where a guess is right
        below = _either(known, self.parts[1] * (np.uint32(1) - two) << _COUNT_SHIFT, self.base + self.rest * self.counts.below.take(ids))
        parts = self.parts[0] * one + self.parts[1] * two
        share = _either(known, parts << _COUNT_SHIFT, self.rest * self.counts.of.take(ids))
        fresh = key << np.uint32(3) | np.uint32(1)
        for slots, at, slot, sure, right in zip(self.slots, self.at, self.slot, self.sure, (one, two)):
            case = (right << np.uint32(3)) + sure
            slots[at] = _either(_ZERO - (case < 2).astype(np.uint32), fresh.copy(), slot + _STEP.take(case))
        live = len(ids)
        self.two[:live] = self.one[:live] * np.uint32(0x27D4EB2F) + ids * np.uint32(0x165667B1) + np.uint32(1)
        self.one[:live] = ids
        return below.astype(np.uint64), share.astype(np.uint64)


def _either(mask: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """``yes`` where all bits of the mask are set, ``no`` where none is; as fast for any mix of them."""
    yes ^= no
    yes &= mask
    yes ^= no
    return yes


def _lengths(n: int) -> np.ndarray:
    return np.minimum(np.arange(n, 0, -BLOCK_IDS), BLOCK_IDS) if n else np.zeros(0, np.int64)


def _narrow(low: np.ndarray, span: np.ndarray, below: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Take each lane's share of its span; returns the lanes that have a word settled.

    A span that got too small without that is cut to the end of its word."""
    unit = span >> _ALL_BITS
    low += unit * below
    np.multiply(unit, share, out=span)
    which = np.flatnonzero(span < _HALF)
    a, s = low[which], span[which]
    across = (a ^ (a + s)) >= _HALF
    span[which] = np.where(across, (np.uint64(0) - a) & (_HALF - np.uint64(1)), s) << _WORD
    return which


def encode(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blocks ``(ids, crc32, code)`` of a sequence of ids below 2**16; the counts of a frame lie before the code of its first block."""
    blocks = []
    for at in range(0, len(ids), FRAME_IDS):
        blocks += _encode(ids[at : at + FRAME_IDS])
    return blocks


def _encode(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    length = _lengths(len(ids))
    lanes = len(length)
    # all blocks are full but the last, so the lanes still at work are always the first ones
    grid = np.zeros(lanes * BLOCK_IDS, np.uint16)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, BLOCK_IDS)
    counts = _Counts.measured(ids)
    model, steps = _Model(lanes, counts), grid.T.copy()
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    out = np.zeros((lanes, BLOCK_IDS + 2), "<u4")
    used = np.zeros(lanes, np.int64)

    def emit(which: np.ndarray) -> None:
        out[which, used[which]] = low[which] >> _WORD
        used[which] += 1
        low[which] <<= _WORD

    for t in range(int(length[0])):
        live = lanes if length[-1] > t else lanes - 1
        model.guess(live)
        below, share = model.shares(steps[t, :live].astype(np.uint32))
        emit(_narrow(low[:live], span[:live], below, share))
    for _ in range(2):
        emit(np.arange(lanes))
    crc = [zlib.crc32(grid[i, : length[i]].astype("<u4").tobytes()) for i in range(lanes)]
    packed = counts.packed()
    head = [len(packed).to_bytes(4, "little") + packed, *[bytes(4)] * (lanes - 1)]
    return [(int(length[i]), crc[i], head[i] + out[i, : used[i]].tobytes()) for i in range(lanes)]


def decode(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of coded blocks; a block whose checksum differs raises ``ValueError``."""
    sizes = [int.from_bytes(b[2][:4], "little") for b in blocks]
    begins = [i for i, n in enumerate(sizes) if n]
    if blocks and (not begins or begins[0]):
        raise ValueError("the first block of a frame of token ids is missing")
    parts = []
    for i, j in zip(begins, [*begins[1:], len(blocks)]):
        counts = _Counts.unpacked(blocks[i][2][4 : 4 + sizes[i]])
        coded = [(n, crc, code[4 + size :]) for (n, crc, code), size in zip(blocks[i:j], sizes[i:j])]
        parts += [_decode(coded[at : at + LANES], counts) for at in range(0, len(coded), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _decode(blocks: list[tuple[int, int, bytes]], counts: _Counts) -> np.ndarray:
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    length = np.array([blocks[i][0] for i in order])
    lanes = len(blocks)
    model = _Model(lanes, counts)
    width = max(len(b[2]) for b in blocks) // 4 + 2
    code_in = np.zeros((lanes, width), np.uint64)
    for k, i in enumerate(order):
        words = np.frombuffer(blocks[i][2], "<u4", len(blocks[i][2]) // 4)
        code_in[k, : len(words)] = words
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    code = code_in[:, 0] << _WORD | code_in[:, 1]
    used = np.full(lanes, 2)
    steps = np.zeros((int(length[0]), lanes), np.uint16)
    most = np.uint64((1 << int(_ALL_BITS)) - 1)
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length, -t, side="left"))
        model.guess(live)
        a, s = low[:live], span[:live]
        ids = model.find(np.minimum((code[:live] - a) // (s >> _ALL_BITS), most).astype(np.uint32))
        which = _narrow(a, s, *model.shares(ids))
        code[which] = code[which] << _WORD | code_in[which, np.minimum(used[which], width - 1)]
        used[which] += 1
        low[which] <<= _WORD
        steps[t, :live] = ids
    grid = steps.T.copy()
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * lanes
    for k, i in enumerate(order):
        out[i] = grid[k, : length[k]]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != blocks[i][1]:
            raise ValueError("a block of token ids does not have its checksum")
    return np.concatenate(out)


#: What the short ways of ``_Tokens`` take for granted of a tokenizer, besides ends of words that are marked.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Small letters that no normal form changes, digits and ASCII signs, and the same splitting for them.
_KNOWN = re.compile("[!-@\\[-~\u00df-\u00f6\u00f8-\u00ff]*")
_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+\\z"
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")


class _Tokens:
    """Ids of texts. White space ends every word of the vocabulary and is dropped, so a text is cut at
    ASCII white space. Case does not count and closing marks right behind a letter or digit are words of
    their own, so the tokenizer sees each such word once, lower-cased and without them. Behind any other
    sign marks belong to that sign's word: those pieces are encoded as they are. Only ASCII letters and digits
    count here; lower-casing another letter may leave a combining sign behind it.

    The tokenizer gets many words as one text, as that takes a third of its time. Words of known letters and signs
    are split here and need no normal form: its model gets them, and marks where each part ends.
    Other words are kept apart by a sign that none of them holds."""

    MARKS = ".,;:!?"
    CLOSED = b"abcdefghijklmnopqrstuvwxyz0123456789"
    APART = "\x01"
    TOGETHER = 64

    def __init__(self, model: str, keep: int = 1 << 18):
        # a task has one core; more threads of the tokenizer only cost memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.bare, self.last, self.between = self._short_ways()
        self.closed = np.zeros(256, bool)
        self.closed[list(self.CLOSED)] = True
        self.keep = keep
        self._forget()

    def _short_ways(self) -> tuple:
        """A tokenizer of words that are split, which ids end a part, and the id of APART; nothing if this one works otherwise."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        known = self.tokenizer
        if known.normalizer is None or known.pre_tokenizer is None or not isinstance(known.model, models.BPE):
            return None, None, None
        normal = json.loads(known.normalizer.__getstate__()).get("normalizers", [])
        split = json.loads(known.pre_tokenizer.__getstate__()).get("pretokenizers", [])
        marked, signs = known.model.end_of_word_suffix, pre_tokenizers.ByteLevel.alphabet()
        if (
            [n["type"] for n in normal] != _NORMAL
            or [(n["pattern"], n["content"]) for n in normal[1:2]] != [({"Regex": r"\s+"}, " ")]
            or [p["type"] for p in split] != ["Split", "ByteLevel"]
            or (split[0]["pattern"], split[0]["invert"]) != ({"Regex": _SPLIT}, True)
            or split[1]["use_regex"]
            or split[1]["add_prefix_space"]
            or not marked
            or known.model.continuing_subword_prefix
            or known.model.dropout
        ):
            return None, None, None
        names = known.get_vocab()
        last = np.zeros(1 << 16, bool)
        last[[i for name, i in names.items() if name.endswith(marked)]] = True
        between = known.encode(self.APART, add_special_tokens=False).ids
        if len(between) != 1 or not all(c + end in names for c in signs for end in ("", marked)):
            return None, None, None
        bare = Tokenizer(known.model)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        return bare, last, between[0]

    def _ids(self, tokenizer: object, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, tokenizer: object, texts: list[str], ends: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one behind the other, and where words end in them."""
        ids = np.concatenate(self._ids(tokenizer, texts))
        return ids, np.flatnonzero(ends(ids)) + 1

    def _encode(self, units: pa.Array) -> np.ndarray:
        """Add distinct units to the known ones; returns the order in which they follow there."""
        step, letters, order = self.TOGETHER, np.zeros(len(units), bool), []
        if self.bare is not None:
            letters = pc.match_substring_regex(units.view(pa.large_string()), _LETTERS).to_numpy(zero_copy_only=False)
        which = np.flatnonzero(letters)
        if len(which):
            words = units.take(pa.array(which)).view(pa.large_string())
            cuts = np.append(np.arange(0, len(which), step), len(which))
            texts = pc.binary_join(pa.ListArray.from_arrays(cuts.astype(np.int32), words), pa.scalar(" ", pa.large_string())).to_pylist()
            ids, ends = self._together(self.bare, texts, self.last.take)
            if len(ends) != len(which):
                raise ValueError("the tokenizer does not mark the end of every part")
            order.append((which, ids, np.diff(ends, prepend=0)))
        parted: tuple[list[int], list[str], list[int]] = [], [], []
        apart: tuple[list[int], list[str]] = [], []
        alone: tuple[list[int], list[str]] = [], []
        rest = np.flatnonzero(~letters)
        for k, unit in zip(rest.tolist(), units.take(pa.array(rest)).to_pylist()):
            word = unit.decode("utf-8", "replace")
            if self.bare is None or b"<|" in unit:
                alone[0].append(k)
                alone[1].append(word)
            elif _KNOWN.fullmatch(word):
                parts = _PARTS.findall(word)
                for some, x in zip(parted, (k, " ".join(parts), len(parts))):
                    some.append(x)
            else:
                here = alone if self.APART in word else apart
                here[0].append(k)
                here[1].append(word)
        if parted[0]:
            texts = [" ".join(parted[1][k : k + step]) for k in range(0, len(parted[0]), step)]
            ids, ends = self._together(self.bare, texts, self.last.take)
            counts = np.cumsum(parted[2])
            if len(ends) != counts[-1]:
                raise ValueError("the tokenizer does not mark the end of every part")
            ends = np.append(0, ends)[counts]
            order.append((parted[0], ids, np.diff(ends, prepend=0)))
        if apart[0]:
            texts = [f" {self.APART} ".join([*apart[1][k : k + step], ""]) for k in range(0, len(apart[0]), step)]
            ids, ends = self._together(self.tokenizer, texts, lambda ids: ids == self.between)
            if len(ends) != len(apart[0]):
                raise ValueError("the tokenizer does not keep words apart")
            order.append((apart[0], ids[ids != self.between], np.diff(ends, prepend=0) - 1))
        if alone[0]:
            found = self._ids(self.tokenizer, alone[1])
            order.append((alone[0], np.concatenate(found), np.array([len(x) for x in found])))
        which, ids, size = (np.concatenate(x) for x in zip(*order))
        size = size.astype(np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype("<u2")])
        self.known = pa.concat_arrays([self.known, units.take(pa.array(which))])
        return which

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.start, self.size = np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _units(self, pieces: pa.Array) -> pa.Array:
        """The word and the closing marks of each piece in turn; either may be empty."""
        special = pc.match_substring(pieces, "<|")  # a special token's name is taken as it is written
        word = pc.if_else(special, pieces, pc.ascii_lower(pieces.view(pa.large_string())).view(pa.large_binary()))
        core = pc.binary_length(pc.ascii_rtrim(word.view(pa.large_string()), self.MARKS)).to_numpy()
        _, offsets, data = word.buffers()
        offsets = np.frombuffer(offsets, np.int64)[word.offset :][: len(word) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        whole = special.to_numpy(zero_copy_only=False) | ((core > 0) & ~self.closed[data[offsets[:-1] + core - 1]])
        core = np.where(whole, np.diff(offsets), core)
        both = np.append(np.stack([offsets[:-1], offsets[:-1] + core], axis=1).ravel(), offsets[-1:])
        return pa.Array.from_buffers(pa.large_binary(), 2 * len(word), [None, pa.py_buffer(both), pa.py_buffer(data)])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one behind the other, and how many each has."""
        named = self._units(pieces).dictionary_encode()
        units = named.dictionary
        if len(self.known) > self.keep:
            self._forget()
        place = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            before = len(self.known)
            which = self._encode(units.take(pa.array(new)))
            place[new[which]] = np.arange(before, before + len(new))
        used = place.take(named.indices.to_numpy())
        size = self.size.take(used)
        return _spans(self.ids, self.start.take(used), size), size[::2] + size[1::2]

    def __call__(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Little-endian 16-bit ids of each text and the end id."""
        if not texts:
            return []
        found = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        bounds = found.offsets.to_numpy()[1:]
        named = found.values.view(pa.large_binary()).dictionary_encode()
        ids, size = self._pieces(named.dictionary)
        ids, size = np.append(ids, np.uint16(end_id)), np.append(size, 1)
        # every piece in turn, the end id as one more behind each text
        used = np.insert(named.indices.to_numpy(), bounds, len(size) - 1)
        start, size = (np.cumsum(size) - size).take(used), size.take(used)
        flat = _spans(ids, start, size).tobytes()
        cuts = (2 * np.cumsum(size)[bounds + np.arange(len(texts))]).tolist()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts)]


def _spans(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of an array one behind the other."""
    ends = np.cumsum(size)
    at = np.repeat(start - ends + size, size)
    at += np.arange(len(at))
    return values.take(at)


FRAME = (
    "part int, frame int, n_ids long, doc_id array<bigint>, n_tokens array<bigint>, "
    "block_ids array<int>, block_crc array<bigint>, block_code array<binary>"
)


def write_ids(documents: DataFrame, path: str, model: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the token ids of all texts as frames, in ascending order of the document id.

    ``model`` is the file of a tokenizer that drops white space and has fewer
    than 2**16 ids; every text ends with ``end_id``. Null and empty texts are that id alone. A
    null id comes first; rows of one id follow each other, by text. An empty
    table writes no frame. A document longer than a frame is one frame.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, frame = _Tokens(model), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            blocks = encode(np.frombuffer(b"".join(held), "<u2"))
            values = [part, frame, total, docs, sizes, *([b[k] for b in blocks] for k in range(3))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            names = [f.split()[0] for f in FRAME.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in few_rows(batches, 1024):
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id").to_pylist()
            for i, j in steps(texts, 1 << 22):
                for doc, own in zip(ids[i:j], tokens(texts[i:j], end_id)):
                    n = len(own) // 2
                    if docs and total + n > FRAME_IDS:
                        yield row()
                        docs, sizes, held, total, frame = [], [], [], 0, frame + 1
                    docs.append(doc)
                    sizes.append(n)
                    held.append(own)
                    total += n
        if docs:
            yield row()

    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidied(code), FRAME).write.parquet(path)


def _frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames in ``path``, each with the number of ids before it."""
    frames = spark.read.schema(FRAME).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a written file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    earlier = W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    starts = frames.select("part", "frame", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("frame_start"))
    starts = starts.join(parts, "part").select("part", "frame", (F.col("part_start") + F.col("frame_start")).alias("start"))
    return frames.join(starts, ["part", "frame"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Per frame: ids of its documents, ids before each, ids of each, and all token ids."""
    for batch in batches:
        columns = [batch.column(c) for c in ("start", "doc_id", "n_tokens", "block_ids", "block_crc", "block_code")]
        for k in range(batch.num_rows):
            start, docs, sizes, *blocks = (c[k].as_py() for c in columns)
            sizes = np.array(sizes, np.int64)
            yield docs, start + np.cumsum(sizes) - sizes, sizes, decode(list(zip(*blocks)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files; ``start`` counts the ids before it."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, start, sizes, ids in _opened(batches):
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes),
                 pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    return _frames(spark, path).mapInArrow(tidied(open_), "doc_id long, start long, n_tokens long, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids``, with the crc32 of the ids as little-endian unsigned 32-bit integers in place of them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, start, sizes, ids in _opened(batches):
            ends = np.cumsum(sizes).tolist()
            crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return _frames(spark, path).mapInArrow(tidied(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
