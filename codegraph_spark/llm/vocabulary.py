"""Reading a word-level BPE vocabulary file: lower-cased NFC text, white space dropped, word ends marked.

The file is a tokenizer description in JSON whose path is a parameter. Supported are files of this kind: normalizers NFC, white space
to one space, lower case; a pre-tokenizer that takes matches of a pattern and maps bytes to printable characters; a BPE model with an
end-of-word suffix; special tokens that are found in the raw text.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

WHITE = r"\t-\r\x20\x85\p{Z}"  # white space of the pattern language of these files
_RUNS_OF_WHITE = regex.compile(f"[{WHITE}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]  # by id, special ones included
    special: dict[str, int]
    inner: np.ndarray  # id of a byte inside a word
    final: np.ndarray  # id of a byte at the end of a word
    pair_keys: np.ndarray  # left * 2**32 + right, ascending
    pair_ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # id that each rank makes
    pattern: regex.Pattern
    special_pattern: regex.Pattern | None

    @property
    def by_pair(self) -> dict[int, int]:
        if not hasattr(self, "_by_pair"):
            self._by_pair = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        return self._by_pair


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def parse(text: str) -> Vocabulary:
    spec = json.loads(text)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not end or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["decoder"]:
        raise ValueError("not a word-level BPE vocabulary of the supported kind")
    ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in [*ids.items(), *special.items()]:
        tokens[i] = t
    keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    letters = byte_letters()
    return Vocabulary(
        tokens,
        special,
        np.array([ids[c] for c in letters], np.int32),
        np.array([ids[c + end] for c in letters], np.int32),
        keys[order],
        order.astype(np.int32),
        np.array([ids[a + b] for a, b in merges], np.int32),
        regex.compile(steps[0]["pattern"]["Regex"]),
        regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None,
    )


def normalized(text: str) -> str:
    """NFC, every code point in lower case by itself (no final sigma); white space stays."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def chunks(text: str) -> list[str]:
    """What stands between white space, normalized. ``str.split`` also divides at U+001C to U+001F, which here are no white space."""
    text = normalized(text)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in _RUNS_OF_WHITE.split(text) if c]
    return text.split()


def segments(text: str | None, vocabulary: Vocabulary) -> list[str]:
    """Pieces of a raw text and, at odd places, the special tokens between them."""
    if not text:
        return [""]
    if vocabulary.special_pattern is None or "<|" not in text and not any(s in text for s in vocabulary.special):
        return [text]
    return vocabulary.special_pattern.split(text)
