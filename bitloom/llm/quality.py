"""Statistics of text quality, and which texts are running prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.words import words
from bitloom.llm.lexicon import COMMON
from bitloom.scratch import materialise

#: A word is common if so large a share of the texts has it; hence the common words are at most the mean number of
#: different words of a text divided by this.
LEAST_SHARE = 0.05
#: Words that a task counts before it hands them on.
COUNTED_AT_ONCE = 500_000

_CLOSERS = " \t\r\v\f\xa0\"'”“»«’‘)]"
_LIST_LINE = re.compile(r"\s*(?:[-*•·–—>+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_CELLS = re.compile(r"\t|\s[|>/·•;]\s|;|\.{4,}| {3,}")
_ENDS = frozenset(".!?…:;")
_DIGITS = frozenset("0123456789")
_TWO_WORDS = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}+[\s,]++[^\W\d_]{2}")


class Stats(NamedTuple):
    """Statistics of one text; shares are 0 where there is nothing to count."""

    n_chars: int
    n_words: int
    mean_word_length: float
    symbol_ratio: float
    number_share: float
    n_lines: int
    punctuated_line_share: float
    list_line_share: float
    cell_share: float
    common_share: float
    duplicate_line_share: float
    duplicate_paragraph_share: float
    top_ngram_share: float
    is_prose: bool


def _repeated(parts: list[str]) -> float:
    """Share of the characters that lie in parts that occurred before."""
    full = [p.strip() for p in parts if p.strip()]
    if len(full) < 2:
        return 0.0
    again = sum((n - 1) * len(p) for p, n in Counter(full).items())
    return again / sum(map(len, full))


def _has_sentence(text: str) -> bool:
    """Whether two words stand side by side and a full stop, question or exclamation mark follows somewhere."""
    m = _TWO_WORDS.search(text)
    return bool(m) and max(map(text.rfind, ".!?…")) >= m.end()


def _top_ngram(tokens: list[str]) -> float:
    """Largest share of the words' characters that the places of one repeated 2- to 4-gram cover at most."""
    n = len(tokens)
    if n < 4 or n - len(set(tokens)) < 2:
        return 0.0
    total, best = sum(map(len, tokens)), 0
    for k in (2, 3, 4):
        grams = Counter(zip(*(tokens[i:] for i in range(k)), strict=False))
        best = max(best, max((c * sum(map(len, g)) for g, c in grams.items() if c > 1), default=0))
    return min(1.0, best / total) if total else 0.0


def prose(n_words: int, common: float, symbols: float, numbers: float, cells: float, commas: float, list_lines: float, punctuated: float, lines_again: float, paragraphs_again: float, ngram: float, sentence: bool) -> bool:
    """The combined rules: what makes a text running prose.

    Running text has common words; lists, tables, menus, code and junk have next to none, but many symbols, numbers,
    cells or list marks. Texts of a few words are judged by their shape. A text that consists of repeated lines,
    paragraphs or of one phrase is none, whatever its words.
    """
    if not n_words or symbols > 0.45 or lines_again > 0.8 or paragraphs_again > 0.6 or (ngram > 0.8 and n_words >= 12):
        return False
    marks = (numbers > 0.2) + (symbols > 0.25) + (cells > 0.12) + (list_lines > 0.5) + (commas > 0.6)
    if numbers > 0.4 and common < 0.3:
        return False
    if common >= 0.16:
        return marks < 3
    if common >= 0.05:
        return marks == 0
    if n_words <= 4:
        return marks == 0 and (sentence or punctuated > 0)
    return marks == 0 and sentence and punctuated >= 0.5 and common > 0


def text_stats(text: str | None, known: frozenset[str] = COMMON) -> Stats:
    """All statistics of one text; known: the common words. Null counts as the empty text: nothing in it, no prose."""
    text = text or ""
    tokens = words(text)
    n = len(tokens)
    letters = sum(map(len, tokens))
    solid = len("".join(text.split()))
    symbols = (solid - min(letters, solid)) / solid if solid else 0.0
    numbers = sum(not _DIGITS.isdisjoint(w) for w in tokens if not w.isalpha()) / n if n else 0.0
    common = sum(map(known.__contains__, tokens)) / n if n else 0.0
    lines = [x for x in text.splitlines() if x.strip()] if "\n" in text else [text] * bool(solid)
    punctuated = sum(x.rstrip(_CLOSERS)[-1:] in _ENDS for x in lines) / len(lines) if lines else 0.0
    listed = sum(_LIST_LINE.match(x) is not None for x in lines) / len(lines) if len(lines) > 1 else 0.0
    cells = len(_CELLS.findall(text)) / n if n else 0.0
    twice, paragraphs = (_repeated(lines), _repeated(text.split("\n\n"))) if len(lines) > 1 else (0.0, 0.0)
    ngram = _top_ngram(tokens)
    is_prose = prose(n, common, symbols, numbers, cells, text.count(",") / max(n, 1), listed, punctuated, twice, paragraphs, ngram, _has_sentence(text) if common < 0.05 else True)
    return Stats(len(text), n, letters / n if n else 0.0, symbols, numbers, len(lines), punctuated, listed, cells, common, twice, paragraphs, ngram, is_prose)


SCHEMA = "n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, number_share double, n_lines bigint, punctuated_line_share double, list_line_share double, cell_share double, common_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_share double, is_prose boolean"


def common_words(records: DataFrame, columns: list[str], least: float = LEAST_SHARE) -> frozenset[str]:
    """The function words of the five languages and the words that at least a share ``least`` of all texts with a word has.

    All texts are counted, each word once a text; the driver gets the common words only (see LEAST_SHARE).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for column in batch.columns:
                for t in column.to_pylist():
                    own = set(words(t))
                    if own:
                        found.update(own)
                        found[""] += 1  # the texts themselves
            if len(found) > COUNTED_AT_ONCE:
                yield part()
        yield part()

    counted = materialise(records.select(*columns).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = next((r["n"] for r in counted.where("word = ''").collect()), 0)
    often = counted.where((F.col("word") != "") & (F.col("n") * 1_000_000 >= round(least * 1_000_000) * total))
    return COMMON | {r["word"] for r in often.select("word").collect()}


def quality(records: DataFrame, id_col: str, sides: dict[str, str]) -> DataFrame:
    """``id``, ``side``, ``blank`` and the statistics: one row for each text of each record.

    sides: name of a side to its column. Null, empty and blank texts are blank and no prose; repeated rows are measured
    each. The words are counted by text first (one shuffle of different words), the statistics are a map.
    """
    base = records.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(sides.values())))
    id_type, names = dict(base.dtypes)["id"], list(sides)
    known = records.sparkSession.sparkContext.broadcast(common_words(records, list(sides.values())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, side in enumerate(names):
                texts = batch.column(1 + k).to_pylist()
                stats = list(zip(*(text_stats(t, known.value) for t in texts), strict=True)) or [()] * len(Stats._fields)
                blank = [not (t and t.strip()) for t in texts]
                columns = [batch.column(0), pa.array([side] * len(texts), pa.string()), pa.array(blank, pa.bool_()), *(pa.array(v, t) for v, t in zip(stats, TYPES, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "side", "blank", *Stats._fields])

    return base.mapInArrow(measure, f"id {id_type}, side string, blank boolean, {SCHEMA}")


TYPES = [{"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]] for f in SCHEMA.split(", ")]


def non_prose(records: DataFrame, id_col: str, sides: dict[str, str]) -> DataFrame:
    """``id``, ``side`` of the non-blank texts that are no running prose."""
    return quality(records, id_col, sides).where("not blank and not is_prose").select("id", "side")
