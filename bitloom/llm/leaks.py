"""Passages of evaluation items inside training documents."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.words import words
from bitloom.operators.skew import union_all

#: Bytes of item text that one automaton holds; more items are taken in blocks.
BLOCK_BYTES = 32 << 20
_automata: dict[str, tuple] = {}


def myers(pattern: list[str], text: list[str]) -> int:
    """Least number of word edits that turn ``pattern`` into some stretch of ``text`` (bit-parallel, any length)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
    return best


def budget(words_of_window: int, window: int, errors: int) -> int:
    """Edits that a window may have: ``errors`` for a full one, in proportion for an item with fewer words."""
    return errors * words_of_window // window if window else 0


def pieces(n: int, window: int, errors: int) -> list[tuple[int, int, int, int]]:
    """(window begin, window length, piece begin, piece end) of all windows of an item of n words.

    Every window is cut into one piece more than its error budget, so with at most so many edits one piece stays whole.
    """
    w = min(window, n)
    k = budget(w, window, errors) + 1
    return [(s, w, s + w * p // k, s + w * (p + 1) // k) for s in range(n - w + 1) for p in range(k)] if n else []


class ItemSearch:
    """An automaton of all pieces of a block of items, and the search of one document with it.

    Windows that several items share are one window: it is verified once at a hit and then counted for each item.
    """

    def __init__(self, items: list[tuple[object, str]], window: int, errors: int):
        self.window, self.errors = window, errors
        self.items = [(i, len(words(t))) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        self.windows: list[tuple[list[str], list[tuple[int, int]]]] = []  # its words; (item, begin) of its places
        number: dict[tuple[str, ...], int] = {}
        table: dict[str, set[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            own, last = words(text), -1
            for s, w, a, b in pieces(len(own), window, errors):
                n = number.setdefault(tuple(own[s : s + w]), len(self.windows))
                if n == len(self.windows):
                    self.windows.append((own[s : s + w], []))
                if s != last:
                    self.windows[n][1].append((k, s))
                    last = s
                table.setdefault(" " + " ".join(own[a:b]) + " ", set()).add((n, a - s))
        for piece, at in table.items():
            self.automaton.add_word(piece, (len(piece), sorted(at)))
        if table:
            self.automaton.make_automaton()
        self.empty = not table

    def search(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item, windows found, windows found word by word, words of the item covered, words of the item)."""
        own = words(text)
        if self.empty or not own:
            return []
        line, starts, found = " " + " ".join(own) + " ", None, {}
        seen = set()
        for end, (length, at) in self.automaton.iter(line):
            starts = starts or list(accumulate((len(w) + 1 for w in own), initial=0))
            j = bisect_right(starts, end - length + 1) - 1
            for n, offset in at:
                d = j - offset
                if (n, d) in seen:
                    continue
                seen.add((n, d))
                wanted = self.windows[n][0]
                w = len(wanted)
                most = budget(w, self.window, self.errors)
                best = found.get(n, most + 1)
                if best == 0:
                    continue
                if d >= 0 and own[d : d + w] == wanted:
                    found[n] = 0
                elif best > 1 and (e := myers(wanted, own[max(0, d - most) : d + w + most])) <= most and e < best:
                    found[n] = e
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for n, e in found.items():
            wanted, places = self.windows[n]
            for k, s in places:
                by_item.setdefault(k, []).append((s, e, len(wanted)))
        out = []
        for k, hits in by_item.items():
            covered = set().union(*(range(s, s + w) for s, _, w in hits))
            out.append((self.items[k][0], len(hits), sum(e == 0 for _, e, _ in hits), len(covered), self.items[k][1]))
        return out


def find_leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, window: int = 10, errors: int = 1) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows``, ``n_exact``, ``covered_words``, ``item_words``: each document with each item it holds.

    An item is looked for in windows of ``window`` consecutive words (an item with fewer words: as a whole), each
    with at most ``errors`` words inserted, left out or changed (in proportion if the item has fewer words). n_windows: windows found; n_exact: those found word
    by word; covered_words: words of the item in found windows. Pigeonhole: a window is cut into errors + 1 pieces,
    pieces are found by one automaton, and the window around a hit is verified by Myers' bit-parallel distance.
    Null and empty texts hold nothing; items without words are found nowhere; repeated item ids are separate rows of
    items and are counted once a pair. A map over the documents, with the items (the stated query set) in blocks.
    """
    spark = documents.sparkSession
    base = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null and item_id is not null").distinct()
    types = dict(base.dtypes)["doc_id"], dict(asked.dtypes)["item_id"]
    schema = f"doc_id {types[0]}, item_id {types[1]}, n_windows bigint, n_exact bigint, covered_words bigint, item_words bigint"
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))

    def one(block: int) -> DataFrame:
        own = [(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).collect()]
        shared, name = spark.sparkContext.broadcast(own), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _automata:
                _automata.clear()
                _automata[name] = (ItemSearch(shared.value, window, errors),)
            (engine,) = _automata[name]
            for batch in batches:
                rows: dict[tuple, tuple] = {}
                for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for hit in engine.search(t):
                        key = (i, hit[0])
                        rows[key] = max(rows.get(key, hit[1:]), hit[1:])
                columns = zip(*((*k, *v) for k, v in rows.items()), strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), arrow, strict=True)], names)

        return base.mapInArrow(search, schema)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    arrow, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    found = union_all([one(b) for b in range(n_blocks)])
    if n_blocks == 1:
        return found
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in names[2:]))
