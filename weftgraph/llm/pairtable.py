"""A hash table from non-negative 64-bit keys to numbers, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing with linear probing; absent keys give `absent`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, absent, np.int64)
        self.absent = absent
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            at = slot[left]
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            placed = left[first]
            self.keys[slot[placed]] = keys[placed]
            self.values[slot[placed]] = values[placed]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], self.absent)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != -1)]
        return out
