"""New sentence pairs by exchanging subtrees, and by blanking or dropping words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import trees as R
from bitloom.functions.hashing import hash_int, hash_unit
from bitloom.operators.filters import candidate_pools, with_spans
from bitloom.operators.joins import numbered, sampled_combinations, sampled_pairs
from bitloom.operators.skew import take_hashed
from bitloom.operators.tree_similarity import similarity
from bitloom.scratch import materialise


def forms(tokens: Column) -> Column:
    """The words of a tree in the order of ids."""
    return F.transform(F.array_sort(tokens), lambda t: t["form"])


def swap_span(tokens: Column, ids: Column, other_tokens: Column, other_ids: Column) -> Column:
    """The words of a tree with those of one span replaced by those of a span of another tree."""
    inside = F.transform(F.array_sort(F.filter(other_tokens, lambda t: F.array_contains(other_ids, t["id"]))), lambda t: t["form"])
    before = F.filter(F.array_sort(tokens), lambda t: t["id"] < F.array_min(ids))
    after = F.filter(F.array_sort(tokens), lambda t: t["id"] > F.array_max(ids))
    form = lambda t: t["form"]
    return F.concat(F.transform(before, form), inside, F.transform(after, form))


def swap_pairs(candidates: DataFrame, pairs: DataFrame, dep: str, method: str, save_original: bool = False) -> DataFrame:
    """``method, draw, pair_a, pair_b, slot, src, tgt``: both sentence pairs that each pair of candidates gives.

    candidates: with_spans rows; dep: ``obj``, ``nsubj``, or ``predicate`` (the single word above the subject).
    Slot 0 is a with b's part, slot 1 b with a's. With save_original also ``original_<method>`` rows. Draws whose
    parts are missing on a side are left out. Two equi-joins on the ids of the members.
    """
    keep = {}
    for s in ("src", "tgt"):
        keep[f"{s}_tokens"] = F.col(f"{s}_tokens")
        ids = F.array(F.col(f"{s}_nsubj.head")) if dep == "predicate" else F.col(f"{s}_{dep}_ids")
        keep[f"{s}_ids"] = F.when(F.element_at(ids, 1) > 0, ids) if dep == "predicate" else ids
    members = candidates.select("pair_id", F.struct(*(c.alias(k) for k, c in keep.items())).alias("m"))
    a = members.select(F.col("pair_id").alias("pair_a"), F.col("m").alias("a"))
    b = members.select(F.col("pair_id").alias("pair_b"), F.col("m").alias("b"))
    joined = pairs.join(a, "pair_a").join(b, "pair_b")
    for s in ("src", "tgt"):
        joined = joined.where(f"a.{s}_ids is not null and b.{s}_ids is not null")
    text = lambda words: F.array_join(words, " ")
    swapped = lambda s, x, y: text(swap_span(F.col(f"{x}.{s}_tokens"), F.col(f"{x}.{s}_ids"), F.col(f"{y}.{s}_tokens"), F.col(f"{y}.{s}_ids")))
    plain = lambda s, x: text(forms(F.col(f"{x}.{s}_tokens")))
    row = lambda name, slot, src, tgt: F.struct(F.lit(name).alias("method"), F.lit(slot).alias("slot"), src.alias("src"), tgt.alias("tgt"))
    made = [row(method, 0, swapped("src", "a", "b"), swapped("tgt", "a", "b")), row(method, 1, swapped("src", "b", "a"), swapped("tgt", "b", "a"))]
    if save_original:
        made += [row(f"original_{method}", 0, plain("src", "a"), plain("tgt", "a")), row(f"original_{method}", 1, plain("src", "b"), plain("tgt", "b"))]
    return joined.select("draw", "pair_a", "pair_b", F.inline(F.array(*made))).select("method", "draw", "pair_a", "pair_b", "slot", "src", "tgt")


def target_pairs(total: int, ratio: float, size: int | None = None, multiplier: float = 1.0) -> int:
    """How many pairs of pairs to draw: half of the wanted sentences, times what filters will take away."""
    wanted = int(size) if size is not None else int(total * ratio)
    return int(int(wanted / 2) * multiplier)


def augment_by_swapping(
    pairs: DataFrame, ratio: float = 0.5, size: int | None = None, seed: int = 123, separate: bool = False, multiplier: float = 1.0,
    same_predicate: bool = True, nouns: bool = False, same_pos: bool = True, save_original: bool = False,
) -> DataFrame:
    """Object and subject exchange over tree pairs (``pair_id, src_tokens, tgt_tokens``).

    N = ratio * pairs (or size) sentences are wanted of each method. With separate pools each dependency has its own
    candidates and draws, else both use the same draws from the pairs eligible for both. The trees and the candidates
    are written once: they are used by the count, the draws and the swaps.
    """
    pairs = materialise(pairs)
    k = target_pairs(pairs.count(), ratio, size, multiplier)
    pools = materialise(candidate_pools(with_spans(pairs), separate, same_predicate, nouns, same_pos))
    out = None
    for dep, method in (("obj", "obj_swapping"), ("nsubj", "subj_swapping")):
        pool = pools.where(F.col("pool") == (dep if separate else "both"))
        drawn = sampled_pairs(pool, "pair_id", k, seed)
        one = swap_pairs(pool, drawn, dep, method, save_original)
        out = one if out is None else out.unionByName(one)
    return out


def lemma_groups(candidates: DataFrame) -> DataFrame:
    """``src_lemma, tgt_lemma, n, first_pair``: pairs by the lemmas of the words above their subjects."""
    keyed = with_predicate_lemmas(candidates)
    return keyed.groupBy("src_lemma", "tgt_lemma").agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("first_pair"))


def with_predicate_lemmas(candidates: DataFrame) -> DataFrame:
    """Rows of with_spans with ``src_lemma`` and ``tgt_lemma``, the lemmas of the heads of the subjects."""
    for s in ("src", "tgt"):
        candidates = candidates.withColumn(f"{s}_lemma", F.trim(R.token_at(F.col(f"{s}_tokens"), F.col(f"{s}_nsubj.head"))["lemma"]))
    return candidates


def swap_same_lemma(candidates: DataFrame, k: int, seed: int, save_original: bool = False) -> DataFrame:
    """Object and subject exchange among pairs whose predicates have the same lemmas on both sides.

    All pairs of each group; if they are more than k, k of them at random.
    """
    keyed = with_predicate_lemmas(candidates).where("src_lemma is not null and tgt_lemma is not null")
    keyed = materialise(keyed)
    chosen = sampled_combinations(keyed, ["src_lemma", "tgt_lemma"], "pair_id", k, seed).withColumn("draw", F.lit(0).cast("bigint"))
    made = [swap_pairs(keyed, chosen, dep, f"{m}_same_predicate_lemma", save_original) for dep, m in (("obj", "obj_swapping"), ("nsubj", "subj_swapping"))]
    return made[0].unionByName(made[1])


def with_similarity(pool: DataFrame, dep: str, kind: str) -> DataFrame:
    """Pool rows with the ``similarity`` of their source and target subtrees, computed for eligible rows only, and
    ``cut_short``: it is a lower limit, because the search for it was not finished."""
    sub = [R.induced(F.col(f"{s}_tokens"), F.col(f"{s}_{dep}_ids")) for s in ("src", "tgt")]
    found = pool.withColumn("_found", similarity(kind, *sub))
    return found.withColumns({"similarity": F.col("_found.similarity"), "cut_short": F.col("_found.cut_short")}).drop("_found")


def similarity_experiment(pool: DataFrame, pairs: DataFrame, dep: str) -> DataFrame:
    """``draw, pair_a, pair_b`` with the similarities by both measures of each pair's own two subtrees before the swap
    (``*_a``, ``*_b``) and of the mixed ones (source subtree of one, target subtree of the other) that a one-sided
    swap would make (``*_ab``, ``*_ba``); ``cut_short`` if one of them is a lower limit.
    """
    subs = [R.induced(F.col(f"{s}_tokens"), F.col(f"{s}_{dep}_ids")).alias(s) for s in ("src", "tgt")]
    members = pool.select("pair_id", F.struct(*subs).alias("m"))
    a = members.select(F.col("pair_id").alias("pair_a"), F.col("m").alias("a"))
    b = members.select(F.col("pair_id").alias("pair_b"), F.col("m").alias("b"))
    joined = pairs.join(a, "pair_a").join(b, "pair_b")
    measures = []
    for kind in ("edge_mapper", "ged"):
        for name, x, y in (("a", "a", "a"), ("b", "b", "b"), ("ab", "a", "b"), ("ba", "b", "a")):
            measures.append(similarity(kind, F.col(f"{x}.src"), F.col(f"{y}.tgt")).alias(f"{kind}_{name}"))
    found = joined.select("draw", "pair_a", "pair_b", *measures)
    names = [c for c in found.columns if c not in ("draw", "pair_a", "pair_b")]
    cut = F.exists(F.array(*(F.col(f"{c}.cut_short") for c in names)), lambda c: c)
    return found.select("draw", "pair_a", "pair_b", *(F.col(f"{c}.similarity").alias(c) for c in names), cut.alias("cut_short"))


#: Draws that one row of the plan of draws stands for.
DRAWS_A_ROW = 50_000


def thresholded_pairs(pool: DataFrame, k: int, threshold: float, seed: int, decay: float = 0.98, floor: float = 1e-3) -> DataFrame:
    """``draw, pair_a, pair_b``: k random pairs of members that both reach a threshold that falls after every k failures.

    The sequential rule is: a pair is accepted if both similarities reach the current threshold, and after k failures
    the threshold is multiplied by ``decay``. Hence the number of accepted draws at a threshold is negative binomial,
    and these are uniform over the pairs of the members that reach it: both are drawn so, at every size, and the first
    k different pairs count. Only the number of members by threshold comes to the driver. The last threshold is the
    floor, where pairs are drawn until k different ones are found or all that exist are taken.
    """
    spark = pool.sparkSession
    steps = [threshold]
    while steps[-1] * decay > floor:
        steps.append(steps[-1] * decay)
    if steps[-1] > floor:
        steps.append(floor)
    level = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t > F.col("similarity")))
    members = materialise(pool.select("pair_id", level.alias("level")).where("similarity is not null"))
    by_level = {r["level"]: r["n"] for r in members.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, reach, running = sum(by_level.values()), [], 0
    for i in range(len(steps)):
        running += by_level.get(i, 0)
        reach.append(running)
    last = reach[-1]
    k = min(k, last * (last - 1))
    if k <= 0:
        return spark.createDataFrame([], "draw bigint, pair_a bigint, pair_b bigint")

    rng = np.random.default_rng(seed)
    accepted: list[tuple[int, int]] = []  # number of draws, members that they are drawn from
    for m in reach[:-1]:
        fails = 1 - m * (m - 1) / (n * (n - 1))
        if fails <= 0:
            break  # all members reach it: it stays until the end
        accepted.append((int(rng.negative_binomial(k, fails)) if m > 1 else 0, m))
    limit = 2 * k + 64
    while True:
        rows, at = [], 0
        for c, m in [*accepted, (limit, last)]:
            c = min(c, limit - at)
            rows += [(at + i, min(DRAWS_A_ROW, c - i), m) for i in range(0, c, DRAWS_A_ROW)]
            at += c
        plan = spark.createDataFrame(rows, "first bigint, n bigint, m bigint")
        plan = plan.repartition(min(len(rows), 200)) if len(rows) > 1 else plan
        draws = plan.select("m", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))
        draws = draws.select("draw", F.pmod(hash_int(seed, "x", F.col("draw")), F.col("m")).alias("x"), F.pmod(hash_int(seed, "y", F.col("draw")), F.col("m") - 1).alias("y"))
        draws = draws.withColumn("y", F.col("y") + (F.col("y") >= F.col("x")).cast("bigint"))
        found = materialise(draws.groupBy("x", "y").agg(F.min("draw").alias("draw")).select("draw", "x", "y"))
        before = sum(c for c, _ in accepted)
        if found.count() >= k:
            # draws are numbers from 0: as the top bits of a 64-bit key they are cut in their order
            chosen = take_hashed(found, F.shiftleft("draw", 63 - limit.bit_length()), k)
            break
        if limit > before and 2 * k > last * (last - 1):
            # most pairs of the last threshold are wanted: those drawn before, then all others in random order
            early = found.where(F.col("draw") < before)
            every = spark.range(last * (last - 1)).select((F.col("id") / (last - 1)).cast("bigint").alias("x"), F.pmod("id", F.lit(last - 1)).alias("y"))
            every = every.withColumn("y", F.col("y") + (F.col("y") >= F.col("x")).cast("bigint")).join(early, ["x", "y"], "left_anti")
            rest = take_hashed(every, F.xxhash64(F.lit(seed), "x", "y"), k - early.count())
            chosen = early.unionByName(rest.select((F.lit(before) + F.col("x") * last + F.col("y")).alias("draw"), "x", "y"))
            break
        limit *= 2
    starts = spark.createDataFrame([(i, (reach[i - 1] if i else 0)) for i in range(len(steps))], "level int, _start bigint")
    placed = numbered(members.where(F.col("level") < len(steps)), "pair_id", seed, "level").join(F.broadcast(starts), "level")
    placed = placed.select((F.col("pos") + F.col("_start")).alias("pos"), "pair_id")
    left = placed.select(F.col("pos").alias("x"), F.col("pair_id").alias("pair_a"))
    right = placed.select(F.col("pos").alias("y"), F.col("pair_id").alias("pair_b"))
    return chosen.join(left, "x").join(right, "y").select("draw", "pair_a", "pair_b")


def augment_by_similarity(pairs: DataFrame, kind: str = "edge_mapper", threshold: float = 0.5, ratio: float = 0.5, size: int | None = None, seed: int = 123, **rules: bool) -> DataFrame:
    """Object and subject exchange in separate pools among pairs whose subtrees are similar across the languages."""
    pairs = materialise(pairs)
    k = target_pairs(pairs.count(), ratio, size)
    pools = materialise(candidate_pools(with_spans(pairs), True, **rules))
    out = None
    for dep, method in (("obj", "obj_swapping"), ("nsubj", "subj_swapping")):
        pool = materialise(with_similarity(pools.where(F.col("pool") == dep), dep, kind))
        one = swap_pairs(pool, thresholded_pairs(pool, k, threshold, seed), dep, method)
        out = one if out is None else out.unionByName(one)
    return out


def depth_probabilities(tokens: Column) -> Column:
    """For each token (in the order of ids) its chance to be changed: softmax of 1 - 2^(1 - depth) over the sentence."""
    factor = F.transform(R.depths(F.array_sort(tokens)), lambda n: F.exp(1 - F.pow(F.lit(2.0), 1 - n)))
    return R.let(factor, _shares)


def _shares(e: Column) -> Column:
    return R.let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))


def softmax_with_temperature(x: Column, t: float) -> Column:
    """Softmax of an array after division by its length as a vector and by the temperature."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return R.let(R.let(norm, lambda n: F.transform(x, lambda v: F.exp(v / n / t))), _shares)


def chosen_positions(probabilities: Column, seed: int, id_col: Column, draws: int = 3) -> Column:
    """1 to ``draws`` distinct positions (from 1), drawn with replacement by the given chances."""
    running = F.aggregate(
        probabilities,
        F.array().cast("array<double>"),
        lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + p)),
    )
    at = lambda run, u: F.least(F.size(run), F.size(F.filter(run, lambda c: c <= u)) + 1)
    draw = lambda run: F.array(*(at(run, hash_unit(seed, f"draw{i}", id_col)) for i in range(draws)))
    return F.array_sort(F.array_distinct(R.let(running, draw)))


def blank_words(tokens: Column, positions: Column, mark: str = "[BLANK]") -> Column:
    """The sentence with the words at the positions blanked."""
    return F.array_join(F.transform(forms(tokens), lambda w, i: F.when(F.array_contains(positions, i + 1), F.lit(mark)).otherwise(w)), " ")


def drop_words(tokens: Column, positions: Column) -> Column:
    """The sentence without the words at the positions."""
    return F.array_join(F.filter(forms(tokens), lambda _, i: ~F.array_contains(positions, i + 1)), " ")


def replace_words(*_: object) -> Column:
    """Depth-based replacement has no defined result."""
    raise NotImplementedError("depth-based replacement is not defined")
