"""A read-only table from 64-bit hashes to numbers, queried by whole arrays."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Open addressing with at least eight slots a key; hash 0 is never found."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (8 * len(hashes)).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        left = np.flatnonzero(hashes)
        at = (hashes & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = self.keys[at[left]] == 0
            _, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[at[placed]], self.values[at[placed]] = hashes[placed], values[placed]
            left = left[~np.isin(left, placed)]
            at[left] = np.where(self.keys[at[left]] != 0, (at[left] + 1) & (size - 1), at[left])

    def get(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where there is none."""
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == h, self.values[at], -1)
        left = np.flatnonzero((there != h) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.keys[at[left]]
            out[left] = np.where(there == h[left], self.values[at[left]], -1)
            left = left[(there != h[left]) & (there != 0)]
        return out
