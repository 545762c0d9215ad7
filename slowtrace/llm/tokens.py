"""Token ids by a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# --- fixed values: how byte-level BPE cuts text before merging, and its printable stand-ins for bytes
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# --- end of fixed values

_LONG_PIECE = re.compile(r"\S{2000}|\s{2000}")


def byte_of_symbol() -> dict[str, int]:
    """The byte each printable stand-in means."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a text without added special tokens, as the tokenizers library gives them for the file.

    The same vocabulary in tiktoken is three times as fast; it takes quadratic time in one long piece without blanks,
    so texts with such a piece go to the library itself, as do files that are not plain byte-level BPE.
    """

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        self._fast = None
        plain = (model["type"] == "BPE" and spec["normalizer"] is None and cut.get("type") == "ByteLevel"
                 and cut.get("use_regex") and not cut.get("add_prefix_space") and not model.get("dropout")
                 and not model.get("unk_token") and not model.get("ignore_merges"))
        if plain:
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            symbols = byte_of_symbol()
            ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self._fast = tiktoken.Encoding("corpus", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is None or len(text) >= 2000 and _LONG_PIECE.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self._fast.encode(text, allowed_special="all"), "<u4")


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
