"""Vectorized work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACES, mix64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
#: Text bytes worked on at once, unless one text is longer.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random odd value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n-1, at least, of the base or of its inverse."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(_INVERSE if inverse else _BASE, size)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null counts as empty."""
    for base in range(0, len(texts), 500):
        part = pc.fill_null(texts.slice(base, 500).cast(pa.large_string()), "")
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            yield base + at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums of values times powers: one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each span."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1
