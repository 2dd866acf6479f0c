"""64-bit hashes of substrings, many at a time, from prefix sums modulo 2^64."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_POWERS = [_Powers(b) for b in BASES]


class SubstringHashes:
    """``of(which, start, end)``: hashes of all data[start:end], for one of the two bases."""

    def __init__(self, data: np.ndarray, bases: int = 2):
        self.sums, self.down = [], []
        wide = data.astype(U64) + U64(1)
        for p in _POWERS[:bases]:
            up, down = p.to(len(data) + 1)
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(wide * up[:len(data)], dtype=U64)]))
            self.down.append(down)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * self.down[which][start])
