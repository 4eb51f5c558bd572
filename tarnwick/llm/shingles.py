"""Hashes of word shingles, computed on whole batches of texts with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)[:n]


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word, a maximal run of bytes other than ASCII white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.r_[1, white.astype(np.int8), 1])
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # Hash of a word: sum of byte * base^(place in the word), from sums over the whole text.
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), dtype=np.uint64)]
        return mix((sums[end] - sums[start]) * powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text with a word is one shingle, one without has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k]
    return mix(out)
