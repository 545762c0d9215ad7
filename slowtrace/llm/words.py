"""Words of texts, and 64-bit hashes of words and of runs of words, for code inside tasks.

A word is a run of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at exactly these bytes. ``bytes.lower()`` lowers
A-Z and nothing else. Both therefore work on UTF-8 as it is, without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_M, _MASK = 0x9E3779B97F4A7C15, 2 ** 64 - 1
_SHORT = np.uint64(0xD1B54A32D192ED03)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null is an empty text."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WordHasher:
    """Hash of each word, remembering the words met; forgets them all when there are too many to hold."""

    class _Known(dict):
        def __missing__(self, word: bytes) -> int:
            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    def __init__(self, remember: int = 300_000):
        self._known, self._remember = self._Known(), remember

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > self._remember:
            self._known.clear()
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int, multiplier: int = _M) -> np.ndarray:
    """A hash of every run of ``n`` consecutive words, made of doubled runs; empty if there are fewer words."""
    if len(hashes) < n:
        return hashes[:0]
    size, done, part, width = len(hashes) - n + 1, 0, hashes, 1
    power, out = multiplier, None
    while True:
        if n & 1:
            tail = part[done:done + size]
            out = tail if out is None else out * np.uint64(power) + tail
            done += width
        n >>= 1
        if not n:
            return mix(out)
        part = part[:-width] * np.uint64(power) + part[width:]
        power, width = power * power & _MASK, 2 * width


def shingle_set(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word shingles; a shorter text counts as one shingle, an empty one has none."""
    if 0 < len(hashes) < n:
        return mix(runs(hashes, len(hashes)) * _SHORT + np.uint64(len(hashes)))
    return np.unique(runs(hashes, n))
