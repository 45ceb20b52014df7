"""Near-duplicate texts by sets of word shingles: prefix filter for candidates, exact Jaccard, greedy leaders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.operators.skew import join_by_counts, many_to_many_join, union_all
from bitloom.scratch import discard, materialise


def distinct_sets(rows: DataFrame, id_col: str, text: str, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sets, members): one row for each distinct set of word shingles, and which rows have it.

    sets: ``set_id`` (the smallest id of its rows), ``shingles``; members: ``set_id``, ``id``. Shingles are hashes of
    ``shingle`` consecutive words (a shorter text is one shingle). Texts without a word have no set.
    """
    words = T.shingle_words(F.col(text))
    n = F.size("_w")
    grams = F.when(n < shingle, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(
        F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, shingle), " ")))
    )
    base = rows.select(F.col(id_col).alias("id"), words.alias("_w")).where(n > 0)
    sized = base.select("id", F.array_sort(F.array_distinct(grams)).alias("shingles"))
    keyed = materialise(sized.withColumn("_key", F.sha2(F.array_join(F.transform("shingles", lambda h: h.cast("string")), ","), 256)))
    firsts = keyed.groupBy("_key").agg(F.min("id").alias("set_id"))
    members = materialise(keyed.select("_key", "id").join(firsts, "_key").select("set_id", "id"))
    sets = keyed.join(firsts.select(F.col("set_id").alias("id")), "id", "left_semi").select(F.col("id").alias("set_id"), "shingles")
    return materialise(sets), members


def near_pairs(sets: DataFrame, share: float = 0.8) -> DataFrame:
    """``a, b, jaccard``: pairs of distinct sets (a < b) at or above ``share``. Exact.

    Prefix filter: shingles are ordered by frequency, and two sets that are similar enough share one of their
    rarest floor((1 - share) n) + 1 shingles. Shingles are joined by value and size band, so only sets of compatible
    sizes meet; sets that are equal were one set before, so a shingle of boilerplate is among the rarest of few sets
    only. Frequent shingles get their counts by broadcast, and a shingle that is still hot is joined by a grid of tasks.
    """
    exploded = sets.select("set_id", F.explode("shingles").alias("h"))
    counts = materialise(exploded.groupBy("h").agg(F.count(F.lit(1)).alias("f")))
    total = counts.agg(F.sum("f")).first()[0] or 0
    ranked = join_by_counts(exploded, counts, ["h"], "f", total).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("o"))
    n = F.size("o")
    prefix = F.slice("o", 1, (F.floor((1 - share) * n + 1e-9) + 1).cast("int"))
    band = F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / share)) + 1e-9) if share < 1 else n
    seeds = ranked.select("set_id", n.alias("n"), band.cast("int").alias("band"), F.explode(prefix).alias("p")).where("p.f > 1")
    seeds = materialise(seeds.select("set_id", "n", "band", F.col("p.h").alias("h")))
    near = F.sequence(F.col("band") - 1, F.col("band") + 1) if share < 1 else F.array("band")
    left = seeds.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "h", F.explode(near).alias("band"))
    right = seeds.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "h", "band")
    fits = (F.col("na") >= share * F.col("nb") - 1e-9) & (F.col("nb") >= share * F.col("na") - 1e-9)
    pairs = many_to_many_join(left, right, ["h", "band"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    x = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    jaccard = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= share)


def greedy_leaders(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``set_id``, ``kept``: scan sets in the order of ids; keep each that no kept earlier one is similar to.

    The sequential rule as a fixpoint: a set whose smaller neighbours are all dropped is kept, one with a kept
    smaller neighbour is dropped; each round decides all sets that it can, reads only what the last one decided, and is
    cut by a written table. Tables that are no longer read are deleted.
    """
    known = materialise(sets.select("set_id").join(pairs.select(F.col("b").alias("set_id")), "set_id", "left_anti").withColumn("kept", F.lit(True)))
    rounds, fresh = [known], known
    open_pairs = materialise(pairs.select("a", "b", F.lit(False).alias("ka")))
    while True:
        # pairs whose first set is decided as dropped say nothing any more; those with a kept one decide the second
        state = open_pairs.drop("ka").join(fresh.select(F.col("set_id").alias("a"), F.col("kept").alias("ka")), "a", "left")
        rest = materialise(state.where("ka is null or ka"))
        by = rest.groupBy("b").agg(F.max(F.coalesce("ka", F.lit(False))).alias("hit"))
        all_b = open_pairs.select("b").distinct().join(by, "b", "left")
        unsure = F.col("hit").isNotNull() & ~F.col("hit")
        decided = materialise(all_b.where(~unsure | F.col("hit").isNull()).select(F.col("b").alias("set_id"), F.col("hit").isNull().alias("kept")))
        if decided.isEmpty():
            return union_all(rounds)
        rounds.append(decided)
        left = materialise(rest.join(decided.select(F.col("set_id").alias("b")), "b", "left_anti"))
        discard(open_pairs, rest)
        open_pairs, fresh = left, decided


__all__ = ["distinct_sets", "greedy_leaders", "near_pairs"]
