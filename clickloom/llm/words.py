"""Words of whole texts and their hashes, computed over the bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. These are single bytes in UTF-8, so the split of the bytes is the split of the text. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch handed to a Python worker, for columns of whole texts. A longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Bytes of text worked on at a time. The arrays below take about 60 times as much; one longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_IS_WORD = ~_SPACES

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def small_batches(spark: SparkSession) -> None:
    """Set ``BATCH`` for this session where it has no setting of its own; the executors' buffers stay as small."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random numbers of 64 bits."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = numbered(256, 11)[_LOWER]
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: np.uint64) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and ends in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[at[0] : at[-1]], at - at[0]) if len(at) else (whole[:0], np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes of text together, one row at least."""
    _, at = text_bytes(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """Hashes of all words of several texts; those of text i are ``hashes[first[i]:first[i + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def edges_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a run also ends where a text ends."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(inside)]] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    return begins, np.flatnonzero(inside & ~after) + 1


def hashed_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes, lower-cased: a polynomial over the prefix sums of all bytes, then mixed."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(len(data), "up", _BASE), out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * _power(len(data) + 1, "down", _UNBASE)[begins])


def words_of(column: pa.Array) -> Words:
    data, at = text_bytes(column)
    begins, ends = edges_of(_IS_WORD[data], at)
    return Words(hashed_runs(data, begins, ends), np.searchsorted(begins, at))


_STEPS = numbered(4096, 77) | np.uint64(1)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _STEPS[k]
    return mixed(total)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has its whole sequence as one, an empty one none."""
    every = grams(words.hashes, size)
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= size:
            yield np.unique(every[begin : end - size + 1])
        elif end > begin:
            own = words.hashes[begin:end]
            yield mixed(np.sum(own * _STEPS[: len(own)], dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
        else:
            yield np.zeros(0, dtype=np.uint64)
