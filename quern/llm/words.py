"""Words and their hashes, as the operators on running text use them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case, ё read as е; a null text has none."""
    return _WORD.findall(text.lower().replace("ё", "е")) if text else []


class WordHasher:
    """64-bit hashes of words, kept in a cache of bounded size."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.seen = limit, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        try:
            return np.array([seen[w] for w in tokens], np.uint64)
        except KeyError:
            for w in tokens:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([seen[w] for w in tokens], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value for each of ``h``."""
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, in order of the text."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _A + h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(32)
    return mix(out * _B)


def text_hash(h: np.ndarray) -> int:
    """One signed 64-bit value for a whole sequence of words."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
