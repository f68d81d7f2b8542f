"""Elias-Fano sequences and the n-gram trie built from them, as flat byte strings."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A sorted sequence of integers: low bits packed, high bits as gaps in a bit string with counts per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            if n:
                begin = np.flatnonzero(np.diff(word, prepend=-1))
                low[word[begin]] = np.bitwise_or.reduceat(part << shift, begin)
            over = np.flatnonzero((at & 63) + bits > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])  # one number at most ends in a word it did not begin in
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) // 64 + 1
        flags = np.zeros(size * 64, bool)
        flags[ones] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, (np.cumsum(count) - count).astype(np.uint32))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.rank, i, side="right") - 1
        bits = self.high[word]
        left = (i - self.rank[word]).astype(np.int64)
        place = np.zeros(len(i), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):  # where the one number ``left`` of the word is
            half = np.bitwise_count((bits >> place) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= half
            left = np.where(go, left - half, left)
            place += np.where(go, np.uint64(step), np.uint64(0))
        upper = (word * 64 + place.astype(np.int64) - i).astype(np.uint64)
        return self._joined(upper, i)

    def values(self) -> np.ndarray:
        """The whole sequence, read in one pass."""
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        return self._joined((ones - i).astype(np.uint64), i)

    def _joined(self, upper: np.ndarray, i: np.ndarray) -> np.ndarray:
        """High bits with the low bits of places ``i``."""
        if not self.low_bits:
            return upper.astype(np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = self.low[word] >> shift
        both |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (upper << np.uint64(self.low_bits) | both & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.rank]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, *rest = arrays
        return cls(int(head[0]), int(head[1]), *rest)


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each at a multiple of eight bytes, behind a table of their kinds and lengths."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
        body.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return np.array(head, np.int64).tobytes() + b"".join(body)


def from_buffer(buffer: np.ndarray) -> list[np.ndarray]:
    """The arrays of ``to_bytes`` as views on a byte array, a memory map for instance."""
    n = int(buffer[:8].view(np.int64)[0])
    head = buffer[8 : 8 + 16 * n].view(np.int64)
    at, out = 8 + 16 * n, []
    for char, length in zip(head[0::2].tolist(), head[1::2].tolist()):
        kind = np.dtype(chr(char))
        out.append(buffer[at : at + length * kind.itemsize].view(kind))
        at += -(-length * kind.itemsize // 8) * 8
    return out


#: log10 of a probability is kept in steps of this size.
STEP = 1 / 4096
#: At least one word in so many successors of a level is sought at once where the level is read whole.
READ_WHOLE = 16


def quantised(probability: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(probability, 1e-300)) / STEP), 65535).astype(np.uint16)


class Level:
    """Successors of the contexts ``first .. first + contexts - 1``: where each context's
    begin, the successors (as context * words + word, so they rise throughout), and quantised log10
    of probabilities and of backoff weights."""

    def __init__(self, arrays: list[np.ndarray]):
        self.first, self.contexts, self.words = (int(x) for x in arrays[0])
        self.pointers, self.successors = EliasFano.from_arrays(arrays[1:5]), EliasFano.from_arrays(arrays[5:9])
        self.probability, self.backoff = arrays[9], arrays[10]

    @staticmethod
    def build(first: int, contexts: int, words: int, context: np.ndarray, word: np.ndarray,
              probability: np.ndarray, backoff: np.ndarray) -> bytes:
        """``context`` and ``word`` sorted; ``backoff`` has a weight for each context."""
        begin = np.searchsorted(context, np.arange(first, first + contexts + 1))
        codes = (context - first) * words + word
        return to_bytes(
            [np.array([first, contexts, words], np.int64), *EliasFano.of(begin, len(word) + 1).arrays(),
             *EliasFano.of(codes, contexts * words).arrays(), quantised(probability), quantised(backoff)]
        )

    def place(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where the word stands among the successors of its context; -1 where it does not follow it."""
        local = context - self.first
        want = local * self.words + word
        if READ_WHOLE * len(want) >= self.successors.n:
            # the successors of all contexts rise, so many words are sought in one pass over them
            held = self.successors.values()
            at = np.searchsorted(held, want)
            return np.where((np.append(held, -1)[at] == want) & (word < self.words), at, -1)
        a, end = self.pointers[local], self.pointers[local + 1]
        b = end.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) // 2
            less = self.successors[mid] < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        there = np.flatnonzero(a < end)
        there = there[self.successors[a[there]] == want[there]] if len(there) else there
        out = np.full(len(context), -1, np.int64)
        out[there] = a[there]
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability (nan where the word does not follow the context) and of the backoff weight."""
        at = self.place(context, word)
        out = np.full(len(context), np.nan)
        there = at >= 0
        out[there] = self.probability[at[there]] * -STEP
        return out, self.backoff[context - self.first] * -STEP
