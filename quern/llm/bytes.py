"""Vectorised word spans and hashes over the bytes of an Arrow text column.

Everything works on the column's own UTF-8 buffer, a few megabytes at a time, so a task needs memory in proportion
to ``BLOCK`` (some 60 bytes for each of its bytes, or of its longest single text's), never to its partition.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; all other characters, whatever their script, belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 3)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x = x * _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def table(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _raised(BLOCK + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; a worker keeps those for a usual block only, a longer text's are made anew."""
    return _kept_powers() if n <= BLOCK + 1 else _raised(n)


class Block:
    """Some rows of a text column: ``data`` their bytes, ``bounds`` where each row begins (one more than rows)."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.rows = len(bounds) - 1

    def words(self, blanks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and for each row the number of its first word (one more than rows)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.rows + 1, np.int64)
        blank = blanks[self.data]
        before = np.empty(n, bool)
        before[0], before[1:] = True, blank[:-1]
        before[self.bounds[:-1][self.bounds[:-1] < n]] = True
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, blank[1:]
        ends = self.bounds[1:]
        after[ends[ends > 0] - 1] = True
        full = ~blank
        starts = np.flatnonzero(full & before)
        return starts, np.flatnonzero(full & after) + 1, np.searchsorted(starts, self.bounds)

    def lead_chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``words``, but each chunk is a run of blanks with the word after it; a row's last may be blanks alone."""
        n = len(self.data)
        if not n:
            return self.words()
        blank = SPACE[self.data]
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = blank[1:] & ~blank[:-1]
        begin[self.bounds[:-1][self.bounds[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each span; ``fold``: of the span with A-Z lowered."""
        values = table(seed)
        if fold:
            values = values.copy()
            values[65:91] = values[97:123]
        n = len(self.data)
        up, down = powers(n + 1)
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum(values[self.data] * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """The rows of a text column (null: empty) in order, in blocks of at most ``limit`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def window_hashes(words: np.ndarray, size: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values; runs that cross rows are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _U(factor)
        out += words[k : n + k]
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of its row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """For each start of a run of ``size`` items: whether the run stays in one row."""
    total = int(bounds[-1])
    n = max(0, total - size + 1)
    left = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + size <= left
