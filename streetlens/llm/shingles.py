"""Hashed word shingles of many texts at once, with numpy: a shingle mixes the hashes of its words."""

from __future__ import annotations

import numpy as np

from .words import MIX, Words, finalize


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words."""
    m = max(0, len(h) - size + 1)
    mixed = np.full(m, np.uint64(size), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            mixed = (mixed ^ h[i : i + m]) * MIX
            mixed ^= mixed >> np.uint64(29)
        return finalize(mixed)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text.

    A text with fewer than ``k`` words, but with one at least, has its whole
    word sequence as the only shingle; a text without words has none.
    """
    every = _mixed(words.hashes, k).view(np.int64)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(_mixed(words.hashes[a:b], b - a).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
