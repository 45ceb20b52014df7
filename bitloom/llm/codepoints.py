"""Texts as flat arrays of code points: hashes and comparison through a skip-and-fold table.

Everything works on one batch of texts at a time; a batch is cut into chunks of bounded size, so that very long
texts cost memory in proportion to the longest single text only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

P31 = np.uint64((1 << 31) - 1)
BASES = (np.uint64(1_103_515_245), np.uint64(1_812_433_253))


def chunks(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Half-open row ranges whose texts have at most ``limit`` code points together (or are one text)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the length of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0 if it is to be skipped."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalnum():
            table[c] = ord(ch.lower()[0])
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter (Unicode L)."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^31-1; grown by doubling and kept."""
    have = _powers.get(int(base), np.ones(1, dtype=np.uint64))
    while len(have) < n:
        step = have[-1] * base % P31
        have = np.concatenate([have, have * step % P31])
    _powers[int(base)] = have
    return have[:n]


def folded_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 62-bit hash of each text reduced to lower-case letters and digits, and whether it has a letter.

    The reduced string is never built: every code point, skipped or not, goes through the table, and its term
    (table value times the base to the number of unskipped code points before it in its text, modulo 2^31-1) is added
    to two polynomials. A skipped code point has the value 0 and does not count, so it adds nothing. None counts as
    the empty text.
    """
    hashes, letters = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
    texts = [t or "" for t in texts]
    for a, b in chunks(texts):
        points, lens = flatten(texts[a:b])
        bounds = np.concatenate([[0], np.cumsum(lens)])
        values = fold_table()[points].astype(np.uint64)
        place = np.concatenate([[0], np.cumsum(values != 0)])
        counts = np.diff(place[bounds])
        exponent = place[:-1] - np.repeat(place[bounds[:-1]], lens)
        out = np.zeros(len(lens), dtype=np.uint64)
        for base in BASES:
            terms = values * powers(base, int(counts.max(initial=0)) + 1)[exponent] % P31
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
            out = (out << np.uint64(31)) | ((total[bounds[1:]] - total[bounds[:-1]]) % P31)
        hashes.append(out.astype(np.int64))
        seen = np.concatenate([[0], np.cumsum(letter_table()[points])])
        letters.append(np.diff(seen[bounds]) > 0)
    return np.concatenate(hashes), np.concatenate(letters)


class _Walk:
    """Pointers into many texts at once: where the next code point that is not skipped stands, and where its run ends."""

    def __init__(self, texts: list[str]):
        self.points, lens = flatten(texts)
        self.limit = np.cumsum(lens)
        self.at = self.limit - lens
        n = len(self.points)
        keep = np.append(fold_table()[self.points] != 0, False)
        places = np.arange(n + 1)
        behind = lambda flags: np.minimum.accumulate(np.where(flags, places, n)[::-1])[::-1]
        self.next, self.stop = behind(keep), behind(~keep)

    def skip(self, rows: np.ndarray) -> np.ndarray:
        """Move the pointers of the rows over what is skipped; whether something is left."""
        self.at[rows] = np.minimum(self.next[self.at[rows]], self.limit[rows])
        return self.at[rows] < self.limit[rows]

    def run(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.stop[self.at[rows]], self.limit[rows]) - self.at[rows]


def equal_folded(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Whether the texts of each row are equal when both are reduced to lower-case letters and digits.

    Two pointers walk each row's texts: each skips what the table skips, then as many code points as both have before
    their next skip are compared through the table, and both move on; a row ends at its first difference. All rows of
    a chunk take their steps together. No reduced text is built.
    """
    out = [np.zeros(0, dtype=bool)]
    left, right = [t or "" for t in left], [t or "" for t in right]
    table = fold_table()
    for a, b in chunks([x if len(x) > len(y) else y for x, y in zip(left, right, strict=True)]):
        x, y = _Walk(left[a:b]), _Walk(right[a:b])
        same = np.ones(b - a, dtype=bool)
        rows = np.arange(b - a)
        while len(rows):
            more_x, more_y = x.skip(rows), y.skip(rows)
            same[rows[more_x != more_y]] = False
            rows = rows[more_x & more_y]
            n = np.minimum(x.run(rows), y.run(rows))
            row = np.repeat(np.arange(len(rows)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            differ = table[x.points[x.at[rows][row] + step]] != table[y.points[y.at[rows][row] + step]]
            same[rows[row[differ]]] = False
            x.at[rows] += n
            y.at[rows] += n
            rows = rows[same[rows]]
        out.append(same)
    return np.concatenate(out)
