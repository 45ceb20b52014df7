"""Words of a text and their hashes, for the Arrow-batched operators.

A word is a longest run of letters and digits (Unicode L and N), lower-cased. Python's ``\\w`` without the underscore
is exactly that set.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_CACHE_LIMIT = 2_000_000


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null. Lower case never splits a word."""
    if not text:
        return []
    if "İ" in text:  # the one letter whose lower case has a mark after it
        return [w.lower() for w in _RUN.findall(text)]
    return _RUN.findall(text.lower())


def has_letter(text: str | None) -> bool:
    """Whether the text has a letter (Unicode L)."""
    if not text:
        return False
    m = _LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(map(str.isalpha, text)))


class _Hashes(dict):
    """Word to hash; a word seen for the first time is hashed."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return h


_cache = _Hashes()


def word_hashes(tokens: list[str] | set[str]) -> list[int]:
    """A signed 64-bit hash of each word; words seen before come from a table of bounded size."""
    if len(_cache) > _CACHE_LIMIT:
        _cache.clear()
    return list(map(_cache.__getitem__, tokens))


def mixed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of each hash as an unsigned cell number."""
    return (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
