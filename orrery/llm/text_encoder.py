"""Byte-level vocabularies behind tiktoken's encoder, for operators that need ids or counts and not a method of their own."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from orrery.llm.bpe import _byte_of_char

#: Characters in a row without a border between words, from which on texts go to an encoder whose time grows in proportion.
LONG = 2048
#: Fixed value: how byte-level vocabularies divide texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """What an encoder is made of; it travels to the tasks as a broadcast."""

    ranks: dict[bytes, int]
    special: dict[str, int]
    ids: np.ndarray
    file: str


def vocabulary(path: str) -> Vocabulary:
    """The byte-level vocabulary file at ``path`` (tokenizers format).

    Single bytes come first, then the merges in order, so that numbers are preferences; special tokens follow. ``ids`` has
    the file's id of each number.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    d, byte_of = json.loads(text), _byte_of_char()
    vocab = d["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
    order = sorted((s for s in vocab if len(s) == 1), key=vocab.__getitem__) + [a + b for a, b in merges]
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    ids = np.array([vocab[s] for s in order] + list(special.values()), "<u4")
    return Vocabulary({bytes(byte_of[c] for c in s): i for i, s in enumerate(order)}, {s: len(order) + i for i, s in enumerate(special)}, ids, text)


def has_long_run(text: str) -> bool:
    """Whether some ``LONG`` characters at a multiple of that number have no border between two words in them."""
    return any(len(text[i : i + LONG].split(None, 1)) < 2 for i in range(0, len(text) - LONG + 1, LONG))


class TextEncoder:
    """Ids of texts as the tokenizers library has them; tiktoken merges long words in quadratic time, so those go to the library."""

    def __init__(self, v: Vocabulary):
        self.ids = v.ids
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens=v.special)
        self.file, self.library = v.file, None

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens that it spells out are taken as such."""
        if not has_long_run(text):
            return self.ids[self.encoding.encode_to_numpy(text, allowed_special="all")]
        if self.library is None:
            self.library = Tokenizer.from_str(self.file)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def tokens_in(self, piece: str) -> int:
        """How many tokens a pre-token has. It is one by itself as well, so that it is not divided again."""
        return len(self.encoding.encode_ordinary(piece))
