"""FM-index of a shard: a suffix array's Burrows-Wheeler transform in a wavelet matrix of packed bits.

Backward search runs for many patterns at once, one symbol of each a step. Patterns are
streamed from their last symbol to the first with the match cut off at a fixed depth, so
each step yields the interval of the pattern's next ``depth`` symbols: the matching
statistics above the threshold. Leaving out the last symbol of a match of full depth
takes one lookup, as the suffixes that agree on ``depth - 1`` symbols are marked.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(suffix array, ranks of all suffixes by their first 2**k symbols for each k) by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, width = {1: rank}, 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:] if width < n else []
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        ranks[width] = rank
        if new[-1] == n - 1:
            return order, ranks


class WaveletMatrix:
    """Rank of symbols in a sequence: a level of packed bits and of block counts for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(sequence), bits, []
        now = sequence.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = (now >> np.uint32(b) & np.uint32(1)).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.append(0, np.cumsum(np.bitwise_count(words))[:-1]).astype(np.int64)
            self.levels.append((words, counts, int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        # where each symbol's run begins in the final order
        self.begin = np.searchsorted(_turned(now, bits), _turned(np.arange(1 << bits, dtype=np.uint32), bits)) if bits <= 22 else None
        self.final = _turned(now, bits)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        at = places
        for level, (words, counts, zeros) in enumerate(self.levels):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((U(1) << (at & 63).astype(np.uint64)) - U(1)))
            at = np.where(one, zeros + ones, at - ones)
        begin = self.begin[symbols] if self.begin is not None else np.searchsorted(self.final, _turned(symbols.astype(np.uint32), self.bits))
        return at - begin


def _turned(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Symbols with their bits reversed: the order of a wavelet matrix's last level."""
    out = np.zeros(len(symbols), np.uint32)
    for b in range(bits):
        out |= (symbols >> np.uint32(b) & np.uint32(1)) << np.uint32(bits - 1 - b)
    return out


class FMIndex:
    """Index of segments, each labelled with a number; answers the least label among the places of a pattern."""

    def __init__(self, segments: list[np.ndarray], labels: np.ndarray, depth: int):
        self.depth = depth
        lengths = np.array([len(s) for s in segments], np.int64)
        every = np.concatenate(segments)
        self.alphabet, ids = np.unique(every, return_inverse=True)
        self.ends = np.cumsum(lengths + 1) - 1  # each segment's separator
        text = np.zeros(len(every) + len(segments), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = ids + 1
        self.text, self.lengths, n = text, lengths, len(text)
        order, ranks = suffix_order(text)
        owner = np.repeat(np.asarray(labels), lengths + 1)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1)))[:-1]
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))
        near = max(w for w in ranks if w <= depth - 1)
        rank = np.append(ranks[near], np.full(depth, -1))
        parted = lambda d: np.append(True, (rank[order[1:]] != rank[order[:-1]]) | (rank[order[1:] + d - near] != rank[order[:-1] + d - near]) | (self._between(rank, order, near, d)))
        shorter = np.flatnonzero(parted(depth - 1))
        self.low = np.repeat(shorter, np.diff(np.append(shorter, n)))
        self.high = np.repeat(np.append(shorter[1:], n), np.diff(np.append(shorter, n)))
        full = np.flatnonzero(parted(depth))
        self.least = np.repeat(np.minimum.reduceat(owner[order], full), np.diff(np.append(full, n)))

    @staticmethod
    def _between(rank: np.ndarray, order: np.ndarray, near: int, d: int) -> np.ndarray:
        """Whether neighbours differ between the first ``near`` symbols and the last ``near`` of d."""
        out = np.zeros(len(order) - 1, bool)
        for at in range(near, d - near, near):
            out |= rank[order[1:] + at] != rank[order[:-1] + at]
        return out

    def symbols(self, pattern: np.ndarray) -> np.ndarray:
        """Ids of words; 0 where a word is not in the index."""
        at = np.minimum(np.searchsorted(self.alphabet, pattern), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == pattern, at + 1, 0)

    def stream(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern and each start of ``depth`` symbols in it, the least label where they occur.

        Patterns are segments of the index or parts of them, so a match can always be extended.
        """
        lengths = np.array([len(p) for p in patterns], np.int64)
        stops = np.cumsum(lengths)
        text = self.symbols(np.concatenate(patterns)) if len(patterns) else np.zeros(0, np.int64)
        found = np.zeros(len(text), np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        n = len(self.text)
        low, high, depth = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64), np.zeros(len(patterns), np.int64)
        live = len(patterns)
        for step in range(int(lengths.max(initial=0))):
            while live and lengths[by_length[live - 1]] <= step:
                live -= 1
            who = by_length[:live]
            place = stops[who] - 1 - step
            symbol = text[place]
            lo, hi, d = low[who], high[who], depth[who]
            cut = d == self.depth
            at = np.minimum(lo, n - 1)
            lo, hi, d = np.where(cut, self.low[at], lo), np.where(cut, self.high[at], hi), d - cut
            ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = self.first[symbol] + ranks[:live], self.first[symbol] + ranks[live:]
            d = d + 1
            if (lo >= hi).any():
                raise ValueError("a pattern is not part of the index")
            whole = d == self.depth
            found[place[whole]] = self.least[lo[whole]]
            low[who], high[who], depth[who] = lo, hi, d
        return [found[b - m : b - self.depth + 1] if m >= self.depth else found[:0] for b, m in zip(stops, lengths, strict=True)]
