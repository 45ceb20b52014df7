"""Repetition inside single documents, by suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.words import word_hashes, words

#: Words sorted together; one longer document is sorted alone.
CHUNK = 400_000


def _doubling(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of many documents at once, and the ranks after each doubling.

    ends[i] is the end of the document of place i; a suffix stops there. Only suffixes that are not yet alone are
    sorted again. Level k holds a number for each place, equal for two places if and only if their first 2^k words
    are equal (shorter suffixes are equal to nothing).
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.concatenate([[True], np.diff(symbols[order]) != 0])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    found, width = [rank.copy()], 1
    active = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))  # indexes into order
    while len(active):
        at = order[active]
        ahead = at + width
        inside = ahead < ends[at]
        behind = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        key = np.lexsort((behind, rank[at]))
        at, behind, old = at[key], behind[key], rank[at[key]]
        order[active] = at
        first = np.concatenate([[True], (np.diff(old) != 0) | (np.diff(behind) != 0)])
        # the suffix that ended is equal to nothing
        first |= behind == 0
        after = np.concatenate([first[1:], [True]])
        rank[at] = np.maximum.accumulate(np.where(first, active, 0))
        found.append(rank.copy())
        active = active[~(first & after)]
        width *= 2
    return order, found


def lcp_of_neighbours(order: np.ndarray, found: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the one before it in the order (0 for the first)."""
    end_a, end_b = ends[order[:-1]], ends[order[1:]]
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(len(a), dtype=np.int64)
    for k in range(len(found) - 1, -1, -1):
        inside = np.flatnonzero((end_a == end_b) & (a < end_a) & (b < end_b))
        equal = inside[found[k][a[inside]] == found[k][b[inside]]]
        total[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    return np.concatenate([[0], total])


def repetition(tokens: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated words, longest repeat in words) of each document.

    tokens: the words of all documents as numbers, one document after the other; counts: their number of words.
    A word is repeated if it lies in a run of ``least`` words that already began at an earlier word of the document.
    The intervals of suffixes with a common prefix of at least ``least`` words are the places of one repeated
    string; all its places but the first are repeats, and the union of their spans is counted.
    """
    n, docs = len(tokens), len(counts)
    longest = np.zeros(docs, dtype=np.int64)
    if not n:
        return np.zeros(docs, dtype=np.int64), longest
    begins = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(docs), counts)
    ends = (begins + counts)[doc]
    _, codes = np.unique(tokens, return_inverse=True)
    order, found = _doubling(doc.astype(np.int64) * (int(codes.max()) + 1) + codes, ends)
    lcp = lcp_of_neighbours(order, found, ends)
    np.maximum.at(longest, doc[order], lcp)
    interval = np.cumsum(lcp < least) - 1
    first = np.full(interval[-1] + 1, n, dtype=np.int64)
    np.minimum.at(first, interval, order)
    repeat = order[order != first[interval]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, repeat, 1)
    np.add.at(cover, np.minimum(repeat + least, n), -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return covered[begins + counts] - covered[begins], longest


def repeated_share(documents: DataFrame, id_col: str, text_col: str, least: int = 8, max_share: float = 0.3, max_longest: int | None = None) -> DataFrame:
    """``id``, ``n_words``, ``repeated_words``, ``share``, ``longest_repeat``, ``over_share``, ``flagged``; one row a document.

    over_share: share > max_share; flagged: that, or longest_repeat > max_longest if given. Null and empty texts have
    no words and share 0. A map over the documents: no shuffle.
    """
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(base.dtypes)["id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            flat: list[int] = []
            counts: list[int] = []
            begin = 0
            for i, text in enumerate(texts.to_pylist()):
                own = word_hashes(words(text))
                if flat and len(flat) + len(own) > CHUNK:
                    yield out(ids.slice(begin, len(counts)), flat, counts)
                    flat, counts, begin = [], [], i
                flat += own
                counts.append(len(own))
            yield out(ids.slice(begin, len(counts)), flat, counts)

    def out(ids: pa.Array, flat: list[int], counts: list[int]) -> pa.RecordBatch:
        n = np.array(counts, dtype=np.int64)
        covered, longest = repetition(np.array(flat, dtype=np.int64), n, least)
        share = covered / np.maximum(n, 1)
        over = covered * 1_000_000 > round(max_share * 1_000_000) * n
        flagged = over | (longest > max_longest) if max_longest is not None else over
        columns = [ids, pa.array(n), pa.array(covered), pa.array(share), pa.array(longest), pa.array(over), pa.array(flagged)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "repeated_words", "share", "longest_repeat", "over_share", "flagged"])

    return base.mapInArrow(measure, f"id {id_type}, n_words bigint, repeated_words bigint, share double, longest_repeat bigint, over_share boolean, flagged boolean")
