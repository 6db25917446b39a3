"""What the operators share: words, hashes and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

#: The six ASCII characters that separate words in the contracts' `[^\x20\x09-\x0D]+`.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased; null has none. bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed at the first look-up; emptied when it has grown to `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The first 56 bytes of XXH3's secret, as numbers of 32 and 64 bits.
_SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e")
_HALVES, _WORDS = np.frombuffer(_SECRET, "<u4"), np.frombuffer(_SECRET, "<u8")


def hashes(words: pa.StringArray, known: WordHashes) -> np.ndarray:
    """xxh3_64 of each word, which has at least one byte: up to 16 bytes by XXH3's short forms on arrays, others by `known`."""
    u, low = np.uint64, np.uint64(0xFFFFFFFF)
    at = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8))
    n, at = np.diff(at), at[:-1] - at[0]
    eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=1)  # the 8 bytes from each byte on
    out = np.empty(len(n), u)

    on = np.flatnonzero(n <= 3)
    a, m = at[on], n[on]
    x = data[a].astype(u) << u(16) | data[a + (m >> 1)].astype(u) << u(24) | data[a + m - 1].astype(u) | m.astype(u) << u(8)
    x ^= u(_HALVES[0] ^ _HALVES[1])
    x = (x ^ x >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> u(29)) * u(0x165667B19E3779F9)
    out[on] = x ^ x >> u(32)

    on = np.flatnonzero((n > 3) & (n <= 8))
    a, m = at[on], n[on]
    x = (eight[a] << u(32)) + (eight[a + m - 4] & low)
    x ^= _WORDS[1] ^ _WORDS[2]
    x = (x ^ (x << u(49) | x >> u(15)) ^ (x << u(24) | x >> u(40))) * u(0x9FB21C651E98DF25)
    x = (x ^ (x >> u(35)) + m.astype(u)) * u(0x9FB21C651E98DF25)
    out[on] = x ^ x >> u(28)

    on = np.flatnonzero((n > 8) & (n <= 16))
    a, m = at[on], n[on]
    x, y = eight[a] ^ (_WORDS[3] ^ _WORDS[4]), eight[a + m - 8] ^ (_WORDS[5] ^ _WORDS[6])
    inner, upper = (x >> u(32)) * (y & low), (x >> u(32)) * (y >> u(32))  # the product's upper 64 bits from those of the halves
    cross = ((x & low) * (y & low) >> u(32)) + (inner & low) + (x & low) * (y >> u(32))
    upper += (inner >> u(32)) + (cross >> u(32))
    x = m.astype(u) + x.byteswap() + y + (x * y ^ upper)
    x = (x ^ x >> u(37)) * u(0x165667919E3779F9)
    out[on] = x ^ x >> u(32)

    on = np.flatnonzero(n > 16)
    out[on] = known.array([data[i : i + k].tobytes() for i, k in zip(at[on].tolist(), n[on].tolist(), strict=True)])
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that a task holds what it makes of few texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Meanwhile rows are read from Parquet and handed to Python at most so many at a time: 10,000 whole texts, Spark's default, are one buffer beside the heap and some in it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in before.items():
            spark.conf.set(name, str(min(rows, int(value)) if int(value) > 0 else rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_libc: list = []


def give_back() -> None:
    """Return memory that the allocators keep to the system: workers outlive their tasks and go from operator to operator."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; when a task begins and ends, memory goes back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
