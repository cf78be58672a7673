"""Words, word hashes and n-gram hashes of Arrow batches, by array arithmetic.

A batch of texts is one byte buffer with offsets, so word boundaries and
hashes come from whole-buffer NumPy operations instead of a loop over words.
All hashes depend on the words alone, never on their place in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_ROWS = 4096
SLICE_BYTES = 500_000  # text handled at once, at some 50 times its size; one longer text makes its own slice
BASE, BASE_WORDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: letters and digits of ASCII, and every byte of other characters
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` texts, unless the session has set a number of
    its own: Spark's default suits short rows, and texts may be long."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))


def give_back() -> None:
    """Return freed memory to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call, and no need for it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, np.uint64(pow(int(base), -1, 2**64)), np.uint64)
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return (data[off[0] : off[-1]], off - off[0]) if len(col) else (data[:0], np.zeros(1, np.int64))


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; memory goes back after each batch."""
    for batch in batches:
        _, off = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        give_back()


@dataclass
class Words:
    """Words of a batch: row, byte span and hash each, and the first word of every row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(col: pa.Array, alnum: bool = False) -> Words:
    """Runs without white space, as they are; or with ``alnum`` the runs of
    letters and digits, lower-cased in ASCII."""
    data, off = buffers(col)
    inside = (_ALNUM if alnum else ~_SPACE)[data]
    if len(data):
        before = np.concatenate(([False], inside[:-1]))
        before[off[:-1][off[:-1] < len(data)]] = False
        after = np.concatenate((inside[1:], [False]))
        after[off[1:][off[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    up, down = _power(BASE, len(data) + 1)
    letters = _BYTES[_FOLD[data] if alnum else data]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * up[:-1], dtype=np.uint64)))
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(row, start, end, hashed, first, data)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all runs of n words inside one row; the position
    is the number of the first word in the batch."""
    m = len(words.hash)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[: m - n + 1] == words.row[n - 1 :])
    return run_hash(words, at, at + n), at


def run_hash(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1 of the batch, for arrays of spans."""
    up, down = _power(BASE_WORDS, len(words.hash) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hash * up[:-1], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * BASE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1 for every i, one after another."""
    total = int(lens.sum())
    step = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
    return np.repeat(starts, lens) + step
