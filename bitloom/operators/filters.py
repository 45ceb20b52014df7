"""Row filters on bitext, and which tree pairs may be augmented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions import trees as R
from bitloom.operators.skew import join_by_counts
from bitloom.operators.stats import exact_quantiles
from bitloom.scratch import materialise


def in_band(n: Column, least: int = 0, most: int = 32, inclusive_max: bool = False) -> Column:
    """least < n < most (or n <= most)."""
    return (n > least) & ((n <= most) if inclusive_max else (n < most))


def compatible(a: Column, b: Column, max_difference: int = 7, max_ratio: float = 1.2) -> Column:
    """Lengths that differ by less than max_difference, or by less than max_ratio either way."""
    return (F.abs(a - b) < max_difference) | (F.coalesce((T.length_ratio(a, b) < max_ratio) & (T.length_ratio(b, a) < max_ratio), F.lit(False)))


def good_length(a: Column, b: Column, least: int = 0, most: int = 32, max_difference: int = 7, max_ratio: float = 1.2, inclusive_max: bool = False) -> Column:
    """Both counts in the band and compatible."""
    return in_band(a, least, most, inclusive_max) & in_band(b, least, most, inclusive_max) & compatible(a, b, max_difference, max_ratio)


def filter_by_length(pairs: DataFrame, src: str, tgt: str, **limits: float) -> DataFrame:
    """Pairs of good length in words between white space. A null text never passes."""
    return pairs.where(good_length(T.word_count(F.col(src)), T.word_count(F.col(tgt)), **limits))


def correct_language(pairs: DataFrame, src_label: str, tgt_label: str, src_lang: str, tgt_lang: str) -> DataFrame:
    """Pairs whose labels are the expected languages."""
    return pairs.where((F.col(src_label) == src_lang) & (F.col(tgt_label) == tgt_lang))


def non_empty(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """Pairs with some text on both sides."""
    return pairs.where((F.length(src) > 0) & (F.length(tgt) > 0))


def without_text(pairs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Pairs in which no column contains the literal text (null columns contain nothing)."""
    for c in columns:
        pairs = pairs.where(~F.coalesce(F.contains(F.col(c), F.lit(text)), F.lit(False)))
    return pairs


def clean_characters(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """Look-alikes fixed, a forbidden first character dropped, and only pairs left that then are clean throughout."""
    fixed = {c: T.drop_forbidden_first(T.fix_lookalikes(T.strip_all(F.col(c)))) for c in (src, tgt)}
    return pairs.withColumns(fixed).where(T.is_clean(F.col(src)) & T.is_clean(F.col(tgt)))


def word_length_band(pairs: DataFrame, column: str, least: float = 2, most: float = 10) -> DataFrame:
    """Rows whose average word length is in the closed band."""
    return pairs.where(T.average_word_length(F.col(column)).between(least, most))


def blank_length_filter(pairs: DataFrame, src: str, tgt: str, most: int = 32, max_difference: int = 8, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """0 < n < most on both sides, and a difference below max_difference or a ratio in [low, high]; n between single blanks."""
    a, b = T.blank_count(F.col(src)), T.blank_count(F.col(tgt))
    return pairs.where((a < most) & (b < most) & ((F.abs(a - b) < max_difference) | T.length_ratio(a, b).between(low, high)))


def few_capitals(pairs: DataFrame, src: str, tgt: str, below: float = 0.15) -> DataFrame:
    """Pairs whose share of capital letters is below the limit on both sides."""
    return pairs.where((T.uppercase_ratio(F.col(src)) < below) & (T.uppercase_ratio(F.col(tgt)) < below))


def one_sentence(docs: DataFrame, *counts: str) -> DataFrame:
    """Rows where the parser found exactly one sentence on every side."""
    for c in counts:
        docs = docs.where(F.col(c) == 1)
    return docs


def tree_pairs(trees: DataFrame, src_side: str = "hun", tgt_side: str = "eng") -> DataFrame:
    """``pair_id, src_tokens, tgt_tokens`` of the pairs that have both trees: one shuffle on pair_id."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("tokens")))
    both = trees.groupBy("pair_id").agg(pick(src_side).alias("src_tokens"), pick(tgt_side).alias("tgt_tokens"))
    return both.where("src_tokens is not null and tgt_tokens is not null")


def with_spans(pairs: DataFrame) -> DataFrame:
    """For both dependencies and sides: the head token and the sorted ids of its subtree, null unless there is exactly one."""
    for dep in ("obj", "nsubj"):
        for side in ("src", "tgt"):
            pairs = pairs.withColumn(f"{side}_{dep}", R.only_with_label(F.col(f"{side}_tokens"), dep))
            pairs = pairs.withColumn(f"{side}_{dep}_ids", R.subtree_ids(F.col(f"{side}_tokens"), F.col(f"{side}_{dep}.id")))
    return pairs


def eligible(dep: str, nouns: bool = False, same_pos: bool = True) -> Column:
    """Whether a pair of with_spans may swap the subtrees of ``dep``.

    One edge of the label on each side and subtrees without gaps; with nouns a noun in each, with same_pos heads of
    the same part of speech.
    """
    ids = [F.col(f"{s}_{dep}_ids") for s in ("src", "tgt")]
    ok = ids[0].isNotNull() & ids[1].isNotNull() & R.is_consecutive(ids[0]) & R.is_consecutive(ids[1])
    if nouns:
        for side, i in zip(("src", "tgt"), ids, strict=True):
            ok &= R.has_noun(R.induced(F.col(f"{side}_tokens"), i))
    if same_pos:
        ok &= F.col(f"src_{dep}.upos").eqNullSafe(F.col(f"tgt_{dep}.upos"))
    return F.coalesce(ok, F.lit(False))


def eligible_both(same_predicate: bool = True, nouns: bool = False, same_pos: bool = True) -> Column:
    """Eligible for both dependencies, whose heads are, with same_predicate, one word on each side."""
    ok = eligible("obj", nouns, same_pos) & eligible("nsubj", nouns, same_pos)
    if same_predicate:
        for side in ("src", "tgt"):
            ok &= F.col(f"{side}_obj.head") == F.col(f"{side}_nsubj.head")
    return F.coalesce(ok, F.lit(False))


def candidate_pools(pairs: DataFrame, separate: bool = False, same_predicate: bool = True, nouns: bool = False, same_pos: bool = True) -> DataFrame:
    """Long form of the pools: one row for each pool (``obj``, ``nsubj``; or ``both``) that a pair of with_spans belongs to."""
    if separate:
        pools = [F.when(eligible(d, nouns, same_pos), F.lit(d)) for d in ("obj", "nsubj")]
    else:
        pools = [F.when(eligible_both(same_predicate, nouns, same_pos), F.lit("both"))]
    return pairs.withColumn("pool", F.explode(F.array_compact(F.array(*pools))))


def extend_pools(pools: DataFrame, seen: DataFrame, pairs: DataFrame, **rules: bool) -> DataFrame:
    """Pools with the candidates of the pairs that were not looked at before (``seen``: their ``pair_id``)."""
    fresh = pairs.join(seen.select("pair_id").distinct(), "pair_id", "left_anti")
    return pools.unionByName(candidate_pools(with_spans(fresh), **rules).select(*pools.columns))


def above_quantile(scored: DataFrame, group: str, src_score: str, tgt_score: str, q: float) -> DataFrame:
    """Rows whose two scores are strictly above the q-quantile of their group (linear interpolation).

    One row of limits a group; hot groups meet theirs by broadcast. Rows without a group are left out.
    """
    found = exact_quantiles(scored.where(F.col(group).isNotNull()), [group], [src_score, tgt_score], (q,))
    pick = lambda c: F.max(F.when(F.col("column_name") == c, F.col("q0")))
    counts = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    limits = materialise(counts.join(found.groupBy(group).agg(pick(src_score).alias("_s"), pick(tgt_score).alias("_t")), group))
    total = limits.agg(F.sum("_n")).first()[0] or 0
    met = join_by_counts(scored, limits, [group], "_n", total)
    return met.where((F.col(src_score) > F.col("_s")) & (F.col(tgt_score) > F.col("_t"))).select(*scored.columns)


def between_quantiles(scored: DataFrame, src_score: str, tgt_score: str, low: float, high: float) -> DataFrame:
    """Rows whose two scores are strictly between the two quantiles of all rows."""
    limits = exact_quantiles(scored, [], [src_score, tgt_score], (low, high)).agg(
        *(F.max(F.when(F.col("column_name") == c, F.col(f"q{i}"))).alias(f"_{n}{k}") for k, c in enumerate((src_score, tgt_score)) for i, n in enumerate(("lo", "hi")))
    )
    kept = scored.crossJoin(F.broadcast(limits))  # one row of limits
    for k, c in enumerate((src_score, tgt_score)):
        kept = kept.where((F.col(c) > F.col(f"_lo{k}")) & (F.col(c) < F.col(f"_hi{k}")))
    return kept.drop("_lo0", "_hi0", "_lo1", "_hi1")
