"""Hashes of words and word runs with numpy, used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
#: What tells the places of a run apart.
SHIFTS = np.arange(1, 65, dtype=U) * STEP
#: Odd multipliers of the two running hashes of `RunHash` and their inverses modulo 2^64.
BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=U, count=len(tokens))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words; of the whole sequence if it is shorter, none if it is empty."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, U(k), dtype=U)
    for i in range(k):
        out = out * U(BASES[0]) + mix(hashes[i:i + n] + SHIFTS[i])
    return mix(out)


class RunHash:
    """128-bit hashes of any run of words of a text, from running sums."""

    powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
    inverse = [np.ones(1, dtype=U), np.ones(1, dtype=U)]

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers[0]) > n:
            return
        size = max(n + 1, 2 * len(cls.powers[0]), 4096)
        for i, base in enumerate(BASES):
            for table, factor in ((cls.powers, base), (cls.inverse, pow(base, -1, 2 ** 64))):
                row = np.full(size, U(factor), dtype=U)
                row[0] = 1
                table[i] = np.multiply.accumulate(row)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._grow(n)
        self.sums = []
        for i in range(2):
            sums = np.zeros(n + 1, dtype=U)
            np.cumsum(mix(hashes + SHIFTS[i]) * self.inverse[i][:n], out=sums[1:])
            self.sums.append(sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words start..end-1, the same wherever the run stands."""
        return tuple(mix((s[end] - s[start]) * p[start]) for s, p in zip(self.sums, self.powers))
