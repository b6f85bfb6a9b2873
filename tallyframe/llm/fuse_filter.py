"""Static three-wise binary fuse filter (Graf and Lemire, 2022) over 64-bit keys, in numpy.

A key's three slots lie in three consecutive segments, so peeling succeeds with
about 1.13 slots a key; one byte a slot gives a false-positive rate of 1/256.
No false negatives. Built once from a key set and never changed after.
"""

from __future__ import annotations

import math

import numpy as np

from .textops import mix

U = np.uint64


def _shape(n: int) -> tuple[int, int]:
    """(segment length, segment count)."""
    length = 1 << min(18, max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return length, max(1, math.ceil(max(n, 1) * factor / length))


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(three slots a key, one-byte fingerprints)."""
    h = mix(keys ^ U(seed))
    first = ((h >> U(40)) * U(segments) >> U(24)).astype(np.int64) * length
    mask = U(length - 1)
    slots = np.stack([first + (h & mask).astype(np.int64), first + length + (h >> U(18) & mask).astype(np.int64), first + 2 * length + (mix(h) & mask).astype(np.int64)])
    return slots, (mix(h ^ U(0x5851F42D4C957F2D)) >> U(56)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, number of keys that sets the shape, slot bytes) for distinct uint64 keys."""
    keys = np.unique(keys)
    n = len(keys)
    length, segments = _shape(n)
    for seed in range(1, 200):
        slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, length, segments)
        size = (segments + 2) * length
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        index = np.arange(n)
        for row in slots:
            np.bitwise_xor.at(owner, row, index)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        peeled = 0
        ready = np.flatnonzero(count == 1)
        while len(ready):
            keys_now, at = np.unique(owner[ready], return_index=True)
            rounds.append((keys_now, ready[at]))
            peeled += len(keys_now)
            touched = slots[:, keys_now]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, keys_now)
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if peeled == n:
            table = np.zeros(size, np.uint8)
            for keys_now, own in reversed(rounds):
                a, b, c = slots[:, keys_now]
                table[own] ^= table[a] ^ table[b] ^ table[c] ^ prints[keys_now]
            return seed, n, table.tobytes()
    raise ValueError("no seed of 199 peels these keys")


def contains(keys: np.ndarray, seed: int, n: int, table: bytes) -> np.ndarray:
    length, segments = _shape(n)
    slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, length, segments)
    t = np.frombuffer(table, np.uint8)
    return (t[slots[0]] ^ t[slots[1]] ^ t[slots[2]]) == prints
