"""Ids of text cuts, kept by a Python worker from task to task.

Cuts are found by one 64-bit hash and held against a second, independent one; a cut whose second
hash differs from that of the cut first seen under its place is encoded by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

from .common import span_hashes


class CutCache:
    """Up to ``most`` cuts; beyond, it starts anew (a bound on memory, not on the input)."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.offs = np.zeros(1, np.int64)
        self.proof = np.zeros(0, np.uint64)

    def encode(
        self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
        encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, first id of each cut (n+1)) of the byte spans; ``encode_new`` gives flat ids and counts."""
        if len(self.place) > self.most:
            self._reset()
        hashes, proof = span_hashes(raw, starts, ends), span_hashes(raw, starts, ends, 1)
        uniq, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.fromiter(map(self.place.get, uniq.tolist(), repeat(-1)), np.int64, len(uniq))
        new = np.flatnonzero(known < 0)
        if len(new):
            data = raw.tobytes()
            new = new[np.argsort((ends - starts)[first[new]], kind="stable")]
            flat, n = encode_new([data[starts[k] : ends[k]] for k in first[new]])
            known[new] = len(self.offs) - 1 + np.arange(len(new))
            self.place.update(zip(uniq[new].tolist(), known[new].tolist()))
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, flat])
            self.proof = np.concatenate([self.proof, proof[first[new]]])
        at = known[inv]
        if not np.array_equal(self.proof[at], proof):
            return self._apart(raw, starts, ends, at, proof, encode_new)
        n = self.offs[at + 1] - self.offs[at]
        out = np.concatenate([[0], np.cumsum(n)])
        src = np.repeat(self.offs[at] - out[:-1], n) + np.arange(int(out[-1]))
        return self.flat[src], out

    def _apart(self, raw, starts, ends, at, proof, encode_new) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the cuts that share a hash with another cut encoded by themselves."""
        parts = []
        for k, place in enumerate(at):
            if self.proof[place] == proof[k]:
                parts.append(self.flat[self.offs[place] : self.offs[place + 1]])
            else:
                parts.append(encode_new([raw[starts[k] : ends[k]].tobytes()])[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
