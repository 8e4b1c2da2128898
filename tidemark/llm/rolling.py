"""Rolling 64-bit hashes of byte strings in NumPy."""

from __future__ import annotations

import numpy as np

from tidemark.llm.shingles import mixed

_rng = np.random.default_rng(20240301)
_VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_tables: dict = {}


def _powers(which: int, n: int):
    """Powers of a base and of its inverse modulo 2 ** 64."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 20)
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            made.append(np.cumprod(step, dtype=np.uint64))
        have = _tables[which] = tuple(made)
    return have


class Rolling:
    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, which: int) -> np.ndarray:
        if which not in self.sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_VALUES[which][self.data] * _powers(which, len(self.data) + 1)[0][: len(self.data)], out=sums[1:])
            self.sums[which] = sums
        return self.sums[which]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all strings of this size."""
        sums = self._sums(0)
        n = len(self.data) - size + 1
        return mixed((sums[size:] - sums[:n]) * _powers(0, len(self.data) + 1)[1][:n])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums = self._sums(0)
        return mixed((sums[stop] - sums[start]) * _powers(0, len(self.data) + 1)[1][start] + (stop - start).astype(np.uint64) * np.uint64(_BASES[1]))

    def windows(self, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the strings of this size from the given starts."""
        out = []
        for which in (0, 1):
            sums = self._sums(which)
            out.append(mixed((sums[start + size] - sums[start]) * _powers(which, len(self.data) + 1)[1][start]))
        return out[0], out[1]
