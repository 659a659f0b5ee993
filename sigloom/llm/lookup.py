"""A set of 64-bit hashes to look others up in."""

from __future__ import annotations

import numpy as np

from sigloom.llm import arrays as A


class Lookup:
    """Positions of hashes that are in a sorted table; a bit map screens them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(16, int(np.ceil(np.log2(len(self.keys) + 1))) + 4)
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> A.U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of h that are keys, and which keys."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.map[self._slot(h)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]
