"""Vectorised tokenising and hashing of Arrow string columns.

Works on the UTF-8 bytes of a batch, a bounded chunk at a time, so memory
follows the chunk (or the longest single text) and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def _byte_values(seed: int) -> np.ndarray:
    """A fixed random 64-bit value per byte; A-Z share those of a-z."""
    t = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
    t = t * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]
    return t


BYTE_VALUE = _byte_values(20240601)
#: Separators: ASCII white space, or every ASCII character that is no letter or digit.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False

_pow: dict[int, np.ndarray] = {}


def _powers(mult: int, n: int) -> np.ndarray:
    have = _pow.get(mult)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        a = np.full(size, mult, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if size <= 4 * CHUNK_BYTES:
            _pow[mult] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        null = np.asarray(column.is_null())
        if (np.diff(off)[null] > 0).any():  # not so in practice; the format allows it
            column = pa.array([x or "" for x in column.to_pylist()], pa.large_string())
            yield from text_chunks(column, limit)
            return
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def release_memory() -> None:
    """Give freed memory and cached powers back to the system: the processes that run tasks are kept for later ones."""
    _pow.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library of this system
        return


class Words:
    """Words of a chunk: byte spans, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data = data
        size = len(data)
        inside = ~separators[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before = np.empty(size, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:size]))
        after = np.empty(size, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # by row, and the end

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, A-Z taken as a-z."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * _powers(_MULT, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _powers(_INV, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(_MULT) + np.uint64(salt))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """For each row of the chunk the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    h = words.hashes()
    n = len(h)
    step = np.uint64(0xD6E8FEB86659FD93)
    s = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        s = s * step + h[k : n - width + 1 + k] if len(s) else s
    s = mix(s)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            v = 0
            for x in h[a:b].tolist():
                v = (v * int(step) + x) & ((1 << 64) - 1)
            out.append(mix(np.array([v ^ (0xA5A5A5A5 * (b - a))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
