"""Vectorised word and shingle hashes over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D; bytes of UTF-8
multi-byte characters are never among those, so byte spans are word spans.
All hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE[SPACES] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_ODD = _rng.integers(1, 2**63 - 1, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(2**40, 2**62)) * 2 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * U(pow(_BASE, k, 2**64))
        k *= 2
    return out


_POWERS = powers(1024)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and each row's first word as an index (one more entry than rows)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    dark = ~SPACES[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets[:-1]] = True
    begins[1:-1] |= ~dark[:-1]
    starts = np.flatnonzero(begins[:-1] & dark)
    stops = np.zeros(len(raw) + 1, bool)
    stops[offsets[1:]] = True
    stops[1:-1] |= ~dark[1:]
    ends = np.flatnonzero(stops[1:] & dark) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each word; with lower, A-Z count as a-z."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    if longest > len(_POWERS):
        _POWERS = powers(longest)
    first = int(starts[0])
    begin = np.zeros(len(raw) - first, np.int64)
    begin[starts - first] = np.diff(starts, prepend=first)
    place = np.arange(len(begin)) - np.cumsum(begin)
    values = (_LOWER if lower else _BYTE)[raw[first:]]
    np.minimum(place, len(_POWERS) - 1, out=place)  # blanks after a word: their value is 0
    values *= _POWERS[place]
    return mix(np.add.reduceat(values, starts - first) + (ends - starts).astype(np.uint64) * _ODD[40])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of words[i:i+k] for each i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _ODD[j % 40] * U(2 * (j // 40) + 1)
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, lower-cased; with fewer words the whole sequence is one."""
    raw, offsets = text_buffers(column)
    for a, b in row_blocks(offsets):
        part, local = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, local)
        words = word_hashes(part, starts, ends, True)
        grams = gram_hashes(words, k)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield mix((words[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _ODD[41 + hi - lo])
            else:
                yield np.zeros(0, np.uint64)
