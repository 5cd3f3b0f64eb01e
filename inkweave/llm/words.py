"""Words and word shingles of texts, hashed in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Longest runs of Unicode letters and digits, lower-cased; none for null."""
    return _RUN.findall(text.lower()) if text else []


class Hasher:
    """64-bit hashes of words, remembered while a task lasts."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        seen = self.seen
        out = []
        for w in found:
            h = seen.get(w)
            if h is None:
                if len(seen) > 500_000:
                    seen.clear()
                h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in order; empty for fewer than n words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            out = (out ^ hashes[i : i + m]) * _M1
            out ^= out >> np.uint64(29)
            out *= _M2
            out ^= out >> np.uint64(32)
    return out
