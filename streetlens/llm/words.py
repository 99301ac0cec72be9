"""Words of many texts at once, with numpy: where they lie and a 64-bit hash of each.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; hashes don't
tell A-Z from a-z. No Python code runs per word: a word's hash is a polynomial
over its bytes, taken from running sums of the whole text. Long words, on which
such polynomials could be made to collide, are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed by xxh3.
LONG = 64
#: Bytes of text that are worked on together, about; a longer text is worked on alone.
BLOCK = 4 << 20
#: Bytes whose running sums are held together.
PIECE = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def finalize(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


with np.errstate(over="ignore"):
    #: A value for each byte; A-Z have those of a-z.
    _VALUE = finalize((np.frombuffer(bytes(range(256)).translate(_TO_LOWER), np.uint8).astype(np.uint64) + np.uint64(1)) * MIX)


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.bases, self.up, self.down = (base, pow(base, -1, 1 << 64)), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in self.bases)
        return self.up[:n], self.down[:n]


_POWERS = Powers(_BASE)


class Words(NamedTuple):
    """Words of texts that lie one after another in ``raw``: byte ranges, hashes, and each text's first word (and their number)."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts ``raw[offsets[i]:offsets[i + 1]]`` (uint8, offsets from 0 on)."""
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts, stops = word.copy(), word
    starts[1:] &= ~word[:-1] | cut[1:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | cut[1:-1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return Words(raw, begin, end, _hashes(raw, begin, end), np.searchsorted(begin, offsets))


def _hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.zeros(len(begin), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, "right")))
            part = raw[begin[i] : end[j - 1]]
            if len(part) <= PIECE:
                up, down = _POWERS.first(PIECE + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
                a, b = begin[i:j] - begin[i], end[i:j] - begin[i]
                out[i:j] = finalize((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * MIX)
            i = j
    for k in np.flatnonzero(end - begin > LONG):
        out[k] = xxhash.xxh3_64_intdigest(raw[begin[k] : end[k]].tobytes().translate(_TO_LOWER))
    return out


def word_hash(word: bytes) -> int:
    """The hash of one word, by the definition."""
    word = word.translate(_TO_LOWER)
    if len(word) > LONG:
        return xxhash.xxh3_64_intdigest(word)
    value = sum(int(_VALUE[b]) * pow(_BASE, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    with np.errstate(over="ignore"):
        return int(finalize(np.array([value], np.uint64) ^ np.array([len(word)], np.uint64) * MIX)[0])


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of runs of neighbouring texts of an Arrow column of strings without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n, (_, place, data) = len(texts), texts.buffers()
    if not n:
        return
    offsets = np.frombuffer(place, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j, words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words_of_texts(texts: list[bytes]) -> Words:
    """The words of a list of texts."""
    return words_of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
