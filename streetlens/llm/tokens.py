"""Token ids as the tokenizers library gives them, for two kinds of vocabulary file.

Encoding a text through the library costs most in splitting and in building its
result objects. Texts of common Latin characters therefore go through a BPE
engine built from the very same file, after a split that is exact for those
characters; every other text goes through the library. Each worker checks the
engine against the library on a set of probes before it uses it, and does
without it if they differ anywhere.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters for which the splits below are exact.
COMMON = re.compile(rf"[\t-\r -~¡-©«-±´¶-¸»¿{LETTERS}‐-‧‰-⁞€]*")
# The split patterns of the two vocabulary kinds, for common characters.
BYTE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
# The same where no two white space characters meet: without look-ahead, which is slow.
BYTE_SPLIT_SINGLE = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+"
DOUBLE_SPACE = re.compile(r"\s\s")
WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+"
PROBES = (
    "", " ", "a", "Hello there, it's we'll they've I'd 12345 67!", "  two  spaces\n\nlines\t tabs \r\n", "Éeau lèvi ßstäpf ciónosta ñ É", "!!! ### $$$ %%% &&& *** | <| |> <|", "a_b-c@d.e x=1;y={2}", "ZEICHEN'S DON'T 'Tis", "word" * 40,
    "“quoted” – dash — € ‰ … ‘it’s’", "thntblere ofthen edtioner in\ninea that. Esly.\n\n\n  ndstnd", "0x1F 3.14 1,000 192.168.0.1", "trailing space ", "¡¿ ok ± § ¶ ·",
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    free = iter(range(256, 512))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Encoder:
    """ids of texts by one vocabulary file."""

    def __init__(self, path: str, fast: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        self.engine = None
        if fast:
            self.engine = self._engine(spec)
            if self.engine is not None and any(self._fast(p) != self._slow([p])[0] for p in PROBES if self.is_common(p)):
                self.engine = None

    def is_common(self, text: str) -> bool:
        return COMMON.fullmatch(text) is not None and not any(s in text for s in self.special) and "\0" not in text

    def _engine(self, spec):
        import tiktoken

        model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
        if model.get("type") != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            return None
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        end = "</w>" if self.words else ""
        ids, merged = {}, []
        # ranks: the 256 bytes, then (words) each byte with the end mark, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)}
        order = [c for c in byte_alphabet()] + ([c + end for c in byte_alphabet()] if end else [])
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            merged.append(a + b)
        for token in [*order, *merged]:
            if token not in model["vocab"] or token in special:
                return None
            body, marked = (token[: -len(end)], True) if end and token.endswith(end) else (token, False)
            raw = bytes(to_byte[c] for c in body) + (b"\0" if marked else b"")
            rank = ranks.setdefault(raw, len(ranks))
            ids.setdefault(rank, model["vocab"][token])
        if sorted(ids) != list(range(len(ranks))):
            return None
        self.ids = np.array([ids[i] for i in range(len(ids))], np.uint32)
        self.split = re.compile(WORD_SPLIT)
        if self.words:
            return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=BYTE_SPLIT_SINGLE, mergeable_ranks=ranks, special_tokens={})
        return tiktoken.Encoding("bytes", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _fast(self, text: str) -> list[int]:
        return self.fast_array(text).tolist()

    def fast_array(self, text: str) -> np.ndarray:
        if self.words:
            parts = self.split.findall(text.lower())
            text = "\0".join(parts) + "\0" if parts else ""
        if not text:
            return np.zeros(0, np.uint32)
        engine = self.engine if self.words or DOUBLE_SPACE.search(text) else self.single
        return self.ids[engine.encode_to_numpy(text, disallowed_special=())]

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.engine is not None and self.is_common(text):
                out[i] = self.fast_array(text)
            else:
                rest.append(i)
        for i in rest:  # one by one: a batch of very long texts would hold all of their results at once
            out[i] = np.array(self._slow([texts[i]])[0], np.uint32)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
