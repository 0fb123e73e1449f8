"""64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_30, _27, _31, _11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look independent."""
    x = x + _A
    x = (x ^ (x >> _30)) * _B
    x = (x ^ (x >> _27)) * _C
    return x ^ (x >> _31)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> _11).astype(np.float64) + 1.0) * 2.0**-53


class Words(dict):
    """Hash of each word by the function `norm` of it, 0 for an empty one; as many are kept as fit."""

    LIMIT = 400_000

    def __init__(self, norm=None):
        super().__init__()
        self.norm = norm

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        w = self.norm(word) if self.norm else word
        found = self[word] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 if w else 0
        return found

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
