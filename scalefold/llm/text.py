"""Texts as UTF-8 bytes and their words as arrays, the common ground of the operators that run in tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Texts of one step of array work; a longer text is a step of its own.
STEP_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_code = np.arange(256)
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~((_code == 0x20) | ((_code >= 0x09) & (_code <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``
LETTERS_DIGITS = ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x61) & (_code <= 0x7A)) | (_code >= 0x80)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1)) * _BASE)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8; a null counts as the empty text."""
    column = batch.column(name)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that only a few texts are copied out of their batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shipped(spark: SparkSession, value: object) -> Callable[[], Any]:
    """Broadcast a value of bounded size; what is returned gives it back inside a task.

    Classes travel with it, as functions do, so executors need no copy of this package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def tidied(make: Callable) -> Callable:
    """A task function that gives the memory it no longer needs back to the system when it ends.

    Workers live on from task to task; what the allocator keeps would count against the next stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return run


class Words(NamedTuple):
    """Words of several texts, in order: the text each is from, its bytes' place in ``data``, a 64-bit key."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def words_of(texts: list[bytes], kept: np.ndarray, keys: bool = True) -> Words:
    """Maximal runs of ``kept`` bytes; no word reaches over the end of a text."""
    between = bytes([int(np.flatnonzero(~kept)[0])])
    data = np.frombuffer(between.join(texts) + between, np.uint8)
    inside = np.concatenate([[False], kept[data]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(first, start, side="right") - 1
    key = np.zeros(len(start), np.uint64)
    if keys and len(start):
        length = end - start
        ahead = np.cumsum(length) - length
        chars = data[inside[1:]]
        offset = np.arange(len(chars)) - np.repeat(ahead, length)
        power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        key = mixed(np.add.reduceat(byte_values(0)[chars] * power[offset], ahead) + length.astype(np.uint64))
    return Words(data, doc, start, end, key)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places start .. start + length - 1, one run after another."""
    ahead = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - ahead, length)
