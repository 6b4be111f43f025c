"""Random draws of a kernel from a counter: draw c of a stream is a hash of (key, c), so a query can be checked in SQL."""

from __future__ import annotations

import hashlib

import numpy as np

# The odd step and the two multipliers of the published 64-bit mixing function (splitmix64).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def stream_key(*parts) -> int:
    """64 bits of md5 over the parts, the same in every process and in SQL."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16], 16)


class Counter:
    """The draws a kernel asks of a generator, in order; nothing but the key and the number of draws so far is kept."""

    def __init__(self, key: int):
        self.key, self.at = np.uint64(key & 0xFFFFFFFFFFFFFFFF), 0
        self.held, self.since = np.zeros(0), 0

    def random(self, size=None):
        """Uniform in (0, 1): 53 bits of the mixed counter."""
        n = 1 if size is None else size if isinstance(size, int) else int(np.prod(size))
        u = self._next(n)
        return float(u[0]) if size is None else u.copy() if isinstance(size, int) else u.reshape(size).copy()

    def _next(self, n: int) -> np.ndarray:
        """The next n draws; a few at a time come from a block made ahead, which grows while they are asked for."""
        a, self.at = self.at, self.at + n
        if n > 64:
            return self._mixed(a, n)
        if a < self.since or a + n > self.since + len(self.held):
            self.since, self.held = a, self._mixed(a, max(n, min(4_096, max(16, 4 * len(self.held)))))
        return self.held[a - self.since : a - self.since + n]

    def _mixed(self, a: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = self.key + np.arange(a + 1, a + n + 1, dtype=np.uint64) * np.uint64(STEP)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    def uniform(self, low=0.0, high=1.0, size=None):
        return low + self.random(size) * (high - low)

    def standard_normal(self, size=None):
        """Box-Muller: as many draws for the lengths, then as many for the angles."""
        a = self.random(size)
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * self.random(size))
        return float(x) if size is None else x

    def normal(self, loc=0.0, scale=1.0, size=None):
        return loc + scale * self.standard_normal(size)

    def integers(self, low, high=None, size=None):
        low, high = (0, low) if high is None else (low, high)
        x = low + np.floor(self.random(size) * (high - low))
        return int(x) if size is None else x.astype(np.int64)

    def permutation(self, x):
        x = np.arange(x) if np.ndim(x) == 0 else np.asarray(x)
        return x[np.argsort(self.random(len(x)), kind="stable")]

    def choice(self, a, size=None, replace=True, p=None):
        """Of range(a) or of the values a; without replacement the smallest of one draw each."""
        values = np.arange(a) if np.ndim(a) == 0 else np.asarray(a)
        if not replace:
            return self.permutation(values)[: 1 if size is None else size]
        if p is None:
            at = self.integers(0, len(values), size)
        else:
            at = np.minimum(np.searchsorted(np.cumsum(p), self.random(size), side="right"), len(values) - 1)
        return values[at]
