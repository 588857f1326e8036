"""Sorted hash arrays with a jump index: vectorised lookups of 64-bit keys."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class SortedHash:
    """Sorted unique uint64 keys; ``find`` gives each query's place, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(int(max(len(keys), 1)).bit_length() + 1, 4)
        self.shift = U64(64 - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.float64)
        top = (keys >> self.shift).astype(np.int64)
        self.jump = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.int32)
        self.longest = int(np.max(np.diff(self.jump))) if len(edges) else 0
        self.padded = np.append(keys, U64(0))

    def find(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int32)
        if not len(self.keys) or not len(q):
            return out
        top = (q >> self.shift).astype(np.int64)
        at, end = self.jump[top], self.jump[top + 1]
        hit = (self.padded[at] == q) & (at < end)
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (at + 1 < end))
        for _ in range(1, self.longest):
            if not len(todo):
                break
            at[todo] += 1
            p = at[todo]
            hit = self.padded[p] == q[todo]
            out[todo[hit]] = p[hit]
            todo = todo[~hit & (p + 1 < end[todo])]
        return out
