"""64-bit hashes of all parts of a text from one pass over its bytes, with numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Each byte has a 64-bit number; a part's hash is their sum weighted by powers of an odd number from its start on, modulo 2^64, mixed."""

    def __init__(self) -> None:
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            turn = pow(_ODD, -1, 1 << 64)
            self.powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_ODD, turn))

    def __call__(self, a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the parts of the bytes ``a`` from ``start`` up to ``end``, not included."""
        self._grow(len(a) + 1)
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.byte[a] * self.powers[: len(a)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverse[start])
