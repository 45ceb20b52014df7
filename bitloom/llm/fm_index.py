"""A full-text index (Burrows-Wheeler) over sequences of word numbers, searched backwards for many patterns at once.

The alphabet is large (words), so ranks come from the sorted places of each symbol in the transformed text instead
of from bit vectors. Places are kept as 32-bit numbers in blocks: one search over the first of each block and a few
halvings inside of a block answer a rank query, and numpy answers all queries of a batch together. With the suffix
array and the text, an index has 12 bytes a word; the words themselves are not in it.
"""

from __future__ import annotations

import numpy as np

#: Places between two sampled ones.
RANK_BLOCK = 64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank, n, width = text.astype(np.int64), len(text), 1
    while True:
        behind = np.full(n, 0, dtype=np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else np.zeros(0, dtype=np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        width *= 2
        if n == 0 or step[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """Index of sequences; each is closed by a separator (code 0), so no match crosses a border.

    text: codes of all sequences; suffixes: where each suffix begins, in their order; places: for each symbol, one
    after the other, its places in the transformed text in ascending order; begins: where the places of each symbol
    begin, which is also where the suffixes that begin with it stand.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray, suffixes: np.ndarray, places: np.ndarray):
        self.symbols, self.text, self.suffixes, self.places = symbols, text, suffixes, places
        self.n = len(text)
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols) + 1))]).astype(np.int64)
        ends = np.flatnonzero(text == 0)
        self.first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(ends), dtype=np.uint32), np.diff(np.concatenate([[-1], ends])))
        sampled = np.arange(0, self.n, RANK_BLOCK)
        self.samples = (np.searchsorted(self.begins, sampled, side="right") - 1) * (self.n + 1) + places[sampled]

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray) -> FMIndex:
        """values: the symbols of all sequences, one after the other; counts: the length of each sequence."""
        symbols, codes = np.unique(values, return_inverse=True)
        text = np.zeros(len(values) + len(counts), dtype=np.int64)
        inner = np.ones(len(text), dtype=bool)
        inner[np.cumsum(counts + 1) - 1] = False
        text[inner] = codes + 1
        order = suffix_order(text)
        places = np.argsort(text[order - 1], kind="stable")
        return cls(symbols, text.astype(np.uint32), order.astype(np.uint32), places.astype(np.uint32))

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Symbol numbers, 0 for values that the index lacks."""
        if not len(self.symbols):
            return np.zeros(len(values), dtype=np.int64)
        some, back = np.unique(values, return_inverse=True)
        at = np.minimum(np.searchsorted(self.symbols, some), len(self.symbols) - 1)
        return np.where(self.symbols[at] == some, at + 1, 0)[back]

    def start(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of one-symbol patterns; empty for code 0."""
        return self.begins[codes], np.where(codes > 0, self.begins[codes + 1], self.begins[codes])

    def rank(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the places of each symbol from ``ends`` on begin: the symbols before them in the transformed text are counted."""
        block = np.searchsorted(self.samples, codes * (self.n + 1) + ends)
        low = np.maximum((block - 1) * RANK_BLOCK, self.begins[codes])
        high = np.maximum(low, np.minimum(block * RANK_BLOCK, self.begins[codes + 1]))
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (self.places[np.minimum(middle, self.n - 1)] < ends)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def extend(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of the patterns with one more symbol in front; (0, 0) where there is none."""
        low2, high2 = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        open_ = np.flatnonzero((codes > 0) & (low < high))
        low2[open_] = self.rank(codes[open_], low[open_])
        high2[open_] = self.rank(codes[open_], high[open_])
        return low2, high2
