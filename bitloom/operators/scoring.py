"""Scores of sentence pairs, and filters by score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bitloom.operators.filters import above_quantile

MAX_ORDER = 4
# fixed values: the public 13a tokenisation, as (pattern, replacement)
TOKENISE_13A = ((re.compile(r"<skipped>"), ""), (re.compile(r"-\n"), ""), (re.compile(r"\n"), " "), (re.compile(r"&quot;"), '"'), (re.compile(r"&amp;"), "&"), (re.compile(r"&lt;"), "<"), (re.compile(r"&gt;"), ">"))
SEPARATE_13A = ((re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))


def tokenise_13a(text: str) -> list[str]:
    """Tokens of the 13a scheme."""
    for pattern, by in TOKENISE_13A:
        text = pattern.sub(by, text)
    text = f" {text} "
    for pattern, by in SEPARATE_13A:
        text = pattern.sub(by, text)
    return text.split()


def bleu_statistics(hypothesis: str, reference: str) -> list[int]:
    """Lengths of both, then for each order the matched and the possible n-grams. They add up over a corpus."""
    h, r = tokenise_13a(hypothesis), tokenise_13a(reference)
    out = [len(h), len(r)]
    for n in range(1, MAX_ORDER + 1):
        a, b = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (h, r))
        out += [(a & b).total(), max(0, len(h) - n + 1)]
    return out


def bleu_of(statistics: list[int], effective_order: bool = False) -> float:
    """BLEU (0 to 100) from summed statistics, with exponential smoothing of orders without a match."""
    h, r = statistics[:2]
    if not h:
        return 0.0
    logs, smooth, orders = 0.0, 1.0, 0
    for n in range(MAX_ORDER):
        matched, possible = statistics[2 + 2 * n : 4 + 2 * n]
        if not possible:
            break
        orders = n + 1
        if matched:
            logs += math.log(100.0 * matched / possible)
        else:
            smooth *= 2
            logs += math.log(100.0 / (smooth * possible))
    if not orders or (orders < MAX_ORDER and not effective_order) or not any(statistics[2::2]):
        return 0.0
    return math.exp(logs / orders) * (1.0 if h >= r else math.exp(1 - r / h))


@F.pandas_udf(DoubleType())
def _sentence_bleu(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
    scores = [None if a is None or b is None else bleu_of(bleu_statistics(a, b), True) for a, b in zip(hypotheses, references, strict=True)]
    return pd.Series(scores, dtype="float64")


def sentence_bleu(hypothesis: Column, reference: Column) -> Column:
    """BLEU of one sentence against one reference, with as many orders as it has; null if a text is null."""
    return _sentence_bleu(hypothesis, reference)


def corpus_bleu(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """One row, ``bleu``: statistics are summed by task and once over all, as a true aggregate. Null texts are left out."""
    from bitloom.functions.types import INTS

    @F.pandas_udf(INTS)
    def statistics(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bleu_statistics(x, y) for x, y in zip(a, b, strict=True)])

    rows = pairs.where(F.col(hypothesis).isNotNull() & F.col(reference).isNotNull()).select(statistics(hypothesis, reference).alias("s"))
    sums = rows.agg(*(F.coalesce(F.sum(F.col("s")[i]), F.lit(0)).alias(f"s{i}") for i in range(2 + 2 * MAX_ORDER)))

    @F.pandas_udf(DoubleType())
    def combine(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bleu_of([int(v) for v in x]))

    return sums.select(combine(F.array(*sums.columns)).alias("bleu"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def mean_vector(vectors: Column, size: int) -> Column:
    """Mean by position of an array of vectors of the given size."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.try_divide(F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")), F.size(vectors).cast("double")),
    )


def round_trip_scores(pairs: DataFrame, to_tgt: Callable[[Column], Column], to_src: Callable[[Column], Column], score: Callable[[Column, Column], Column], src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs with ``<src>_translation``, ``<tgt>_translation`` (each made from the other side by a provider) and
    ``tgt_similarity``, ``src_similarity``: the score of each side against the translation into its language."""
    done = pairs.withColumns({f"{src}_translation": to_src(F.col(tgt)), f"{tgt}_translation": to_tgt(F.col(src))})
    return done.withColumns({f"{s}_similarity": score(F.col(s), F.col(f"{s}_translation")) for s in (src, tgt)})


def meteor(candidate: list[str], reference: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of two token lists with exact matches only (stems and synonyms need outside word lists).

    Words are matched from the end, each with the last equal one that is free; a chunk is a stretch of matches that
    are neighbours on both sides.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(reference):
        places.setdefault(w, []).append(j)
    pairs = [(i, places[candidate[i]].pop()) for i in range(len(candidate) - 1, -1, -1) if places.get(candidate[i])][::-1]
    if not pairs:
        return 0.0
    precision, recall = len(pairs) / len(candidate), len(pairs) / len(reference)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    chunks = 1 + sum((b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(pairs[:-1], pairs[1:], strict=True))
    return mean * (1 - gamma * (chunks / len(pairs)) ** beta)


@F.pandas_udf(DoubleType())
def sentence_meteor(candidates: pd.Series, references: pd.Series) -> pd.Series:
    """METEOR of each pair of texts (lower case, words and signs as tokens); null if one is null."""
    tokens = lambda t: re.findall(r"\w+|[^\w\s]", t.lower())
    return pd.Series([None if a is None or b is None else meteor(tokens(a), tokens(b)) for a, b in zip(candidates, references, strict=True)], dtype="float64")


def corpus_meteor(pairs: DataFrame, candidate: str, reference: str) -> DataFrame:
    """``n``, ``meteor``: the mean over all pairs that have both texts."""
    return pairs.select(sentence_meteor(F.col(candidate), F.col(reference)).alias("m")).agg(F.count("m").alias("n"), F.avg("m").alias("meteor"))


class ScoreFilter(Protocol):
    """Scores both sides of augmented pairs and keeps the best; draws are multiplied by ``multiplier`` beforehand."""

    multiplier: float

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class QuantileFilter:
    """Keeps pairs whose two scores are strictly above the q-quantile of their method."""

    def __init__(self, src_score: Column, tgt_score: Column, q: float = 0.0):
        self.src_score, self.tgt_score, self.q, self.multiplier = src_score, tgt_score, q, 1 + q

    def __call__(self, pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumns({"src_score": self.src_score, "tgt_score": self.tgt_score})
        return above_quantile(scored, "method", "src_score", "tgt_score", self.q)


class BleuFilter(QuantileFilter):
    """Round-trip filter: each side against the translation of the other, by a provider of two columns."""

    def __init__(self, to_tgt: Callable[[Column], Column], to_src: Callable[[Column], Column], q: float = 0.0):
        super().__init__(sentence_bleu(to_src(F.col("tgt")), F.col("src")), sentence_bleu(to_tgt(F.col("src")), F.col("tgt")), q)


class CosineFilter(QuantileFilter):
    """Each side's vector against that of the translation of the other, by a provider of vectors."""

    def __init__(self, to_tgt: Callable[[Column], Column], to_src: Callable[[Column], Column], src_vector: Callable[[Column], Column], tgt_vector: Callable[[Column], Column], q: float = 0.0):
        super().__init__(cosine(src_vector(to_src(F.col("tgt"))), src_vector(F.col("src"))), cosine(tgt_vector(to_tgt(F.col("src"))), tgt_vector(F.col("tgt"))), q)


FILTERS: dict[str, type] = {"bleu": BleuFilter, "cosine": CosineFilter, "quantile": QuantileFilter}
