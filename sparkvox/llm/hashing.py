"""Words of Arrow text batches as 64-bit hashes, in NumPy.

Runs inside tasks on one Arrow batch; texts of any length are worked through
in segments, so memory stays a small multiple of a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
#: Rows are taken together up to this many bytes of text.
GROUP_BYTES = 8 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit number per byte value.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SEGMENT), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string column in UTF-8; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), off


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _segments(data: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Pieces of about SEGMENT bytes that end behind white space."""
    while start < stop:
        end = min(start + SEGMENT, stop)
        if end < stop:
            spaces = np.flatnonzero(IS_SPACE[data[start:end]])
            if len(spaces):
                end = start + int(spaces[-1]) + 1
            else:  # one long word: up to the next space
                while end < stop:
                    further = min(end + SEGMENT, stop)
                    spaces = np.flatnonzero(IS_SPACE[data[end:further]])
                    if len(spaces):
                        end += int(spaces[0]) + 1
                        break
                    end = further
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of the words ``[^\\x20\\x09-\\x0D]+`` of the rows that
    ``offsets`` bound, in order; ``lower``: A-Z first become a-z."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    table = LOWER if lower else SAME
    for s, e in _segments(data, int(offsets[0]), int(offsets[-1])):
        x = table[data[s:e]]
        word = ~IS_SPACE[x]
        apart = np.zeros(e - s + 1, bool)  # a row begins here
        inside = offsets[np.searchsorted(offsets, s, "right"):np.searchsorted(offsets, e, "left")]
        apart[inside - s] = True
        apart[0] = apart[-1] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | apart[1:-1]
        last[:-1] &= ~word[1:] | apart[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        p, q = powers(e - s)
        v = BYTE[x] * p
        c = np.cumsum(v)
        h = (c[b] - c[a] + v[a]) * q[a]
        hashes.append(mix(h + (b - a + 1).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, a + s, "right") - 1)
    return np.concatenate(hashes), np.concatenate(rows)
