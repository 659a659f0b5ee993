"""A compressed full-text index: Burrows-Wheeler transform in a wavelet tree.

The tree (as a wavelet matrix) keeps one bit vector for each bit of the
alphabet: packed bytes, and a running count every 64 bits. All queries are
vectorised: a step serves every pattern at once.
"""

from __future__ import annotations

import numpy as np

from sigloom.llm.suffixes import suffix_array

_BLOCK = 64


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.concatenate([bits, np.zeros(-len(bits) % _BLOCK + _BLOCK, dtype=bool)])
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w, k = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[w] & ((np.uint64(1) << k) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below)


class FMIndex:
    """Counts patterns of a text of symbols 0..sigma-1."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_array(text)
        # The end of the text is a symbol of its own, before all others.
        shifted = text.astype(np.int64) + 1
        bwt = np.concatenate([[shifted[-1]] if n else [], np.where(order > 0, shifted[order - 1], 0) if n else []]).astype(np.int64)
        self.size = n + 1
        sigma = int(shifted.max()) + 1 if n else 1
        counts = np.bincount(bwt, minlength=sigma + 1) if n else np.zeros(2, np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (bwt >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

        # Where each symbol's part of the last level begins.
        self.begin = self._walk(np.arange(1 << self.depth), np.zeros(1 << self.depth, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places followed down the tree by the bits of a symbol."""
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        return self._walk(symbol, at) - self.begin[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of symbol + pattern."""
        symbol = symbol + 1
        at = self._rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + at[: len(low)], start + at[len(low) :]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, cap: int, least: int = 2) -> np.ndarray:
        """For each end, the length (cap at most) of the longest string that ends
        just before it in `text` and occurs `least` times in the index. A string
        stops before any symbol that the index doesn't have (< 0)."""
        best = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        alive = np.arange(len(ends))
        for k in range(1, cap + 1):
            alive = alive[ends[alive] - k >= 0]
            symbol = text[ends[alive] - k]
            alive, symbol = alive[symbol >= 0], symbol[symbol >= 0]
            if not len(alive):
                break
            low[alive], high[alive] = self.extend(symbol, low[alive], high[alive])
            alive = alive[high[alive] - low[alive] >= least]
            best[alive] = k
        return best
