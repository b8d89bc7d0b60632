"""Texts of an Arrow batch as flat numpy arrays: bytes, document bounds, words, hashes.

Helpers for operators that work inside ``mapInArrow`` tasks. A batch is cut into
chunks of whole rows with a bounded number of bytes (a longer text is a chunk of
its own), so memory follows the chunk and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LETTER, DIGIT, MARK, BLANK = range(4)
BYTE_CLASS = np.full(256, MARK, np.uint8)      # bytes of other alphabets count as letters
BYTE_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
BYTE_CLASS[48:58] = DIGIT
BYTE_CLASS[SPACE] = BLANK

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


MAX_RECORDS = 1000        # rows of an Arrow batch: texts are long, so a batch has few


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same frame; the session's Arrow batches are held to MAX_RECORDS rows from now on.

    Spark bounds batches by rows only, and its default of 10,000 is meant for short rows.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= MAX_RECORDS:
        conf.set(key, str(MAX_RECORDS))
    return df


def release_memory() -> None:
    """Give memory that a finished task has freed back to the system; workers are reused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; a null text has no bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets): row ``i`` has the bytes ``offsets[i]:offsets[i + 1]``.

    A null text has no bytes.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = flat(column)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
            last = min(max(last, first + 1), len(column))
            yield (batch.slice(first, last - first), data[offsets[first]:offsets[last]],
                   offsets[first:last + 1] - offsets[first])
            first = last
    release_memory()


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` rows of ``values``; empty groups give 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class within one document: starts, ends and classes."""
    n = len(classes)
    new = np.ones(n, bool)
    new[1:] = classes[1:] != classes[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    return starts, ends, classes[starts]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: starts, ends and words per document."""
    starts, ends, space = runs(SPACE[data], offsets)
    starts, ends = starts[~space], ends[~space]
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray, byte_values: np.ndarray = _BYTES) -> np.ndarray:
    """Prefix sums from which ``substring_hashes`` takes the hash of any range."""
    power, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values[data] * power[:len(data)], out=sums[1:])
    return sums


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes have equal hashes in every chunk."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def range_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` bytes from every position."""
    size = max(0, len(prefix) - n)
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[n:n + size] - prefix[:size]) * inverse[:size])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries (document bounds are the caller's)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k:k + size]
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words and the number of words per document."""
    starts, ends, counts = words(data, offsets)
    return substring_hashes(prefix_hashes(data), starts, ends), counts
