"""Statistics of one document, each computed on first use.

Words are runs outside ``\\x20`` and ``\\x09-\\x0D``, as ``bytes.split()`` yields.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property

import numpy as np

SYMBOLS = b"#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Doc:
    """Counts of one text; an empty one has zeros everywhere."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that do not continue one."""
        joined = b"".join(self.words)
        return len(joined.decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines, split at \\n, that have a word."""
        return [line for line in self.raw.split(b"\n") if line.split(None, 1)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_distinct(self) -> int:
        return int(self.codes.max()) + 1 if self.n_words else 0

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows found twice or more in the text."""
        n = self.n_words
        if n < 4:
            return 0
        c, base = self.codes, self.n_distinct
        pairs = np.unique(c[:-1] * base + c[1:], return_inverse=True)[1]
        keys = pairs[:-1] * base + c[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : i + len(twice)] |= twice
        return int(inside.sum())

    @cached_property
    def n_chars(self) -> int:
        return len(self.text)

    @cached_property
    def n_letters(self) -> int:
        return len(LETTER.findall(self.text))

    @cached_property
    def n_upper(self) -> int:
        return len(UPPER.findall(self.text))

    @cached_property
    def n_digits(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"0123456789"))

    @cached_property
    def n_shouts(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_wordlike(self) -> int:
        """Words that begin with a letter, or a byte outside ASCII."""
        return sum(1 for w in self.words if w[:1].isalpha() or w[0] > 127)

    @cached_property
    def n_top_word(self) -> int:
        """Occurrences of the most frequent word."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_sentence_ends(self) -> int:
        return self.raw.count(b".") + self.raw.count(b"?") + self.n_shouts
