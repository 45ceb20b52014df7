"""Joins and cuts that hold when one key has a third of all rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A key is hot if it has more than one in HOT_SHARE of all rows; hence there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500


def join_by_counts(big: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``keyed`` (one row a key, with the number ``count`` of its rows in ``big``).

    The hot keys, fewer than HOT_SHARE by definition, are broadcast with their few columns; the rows of all other
    keys meet by a shuffle in which no key has more than a HOT_SHARE-th of the rows. ``keyed`` must not hold long
    values. Null keys match nothing.
    """
    hot = keyed.where(F.col(count) > F.lit(total / HOT_SHARE))
    cold = keyed.where(F.col(count) <= F.lit(total / HOT_SHARE))
    marks = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys, "inner").unionByName(
        big.join(marks, keys, "left_anti").join(cold, keys, "inner")
    )


def salted_join(big: DataFrame, keyed: DataFrame, key: str, count: str, by: Column, per_copy: int = 10_000) -> DataFrame:
    """Inner join on ``key`` where ``big`` itself says in ``count`` how many of its rows the key has.

    A row of ``keyed`` (with the same ``count``) is copied once for every ``per_copy`` rows that it meets, so that no
    task sees more than about ``per_copy`` rows of one key; the copies number at most one a key plus one in
    ``per_copy`` rows of ``big``.
    """
    copies = F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(per_copy))).cast("int")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), copies).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(count)
    return left.join(right, [key, "_salt"], "inner").drop("_salt")


def many_to_many_join(left: DataFrame, right: DataFrame, keys: list[str], per_cell: int = 10_000) -> DataFrame:
    """Inner join on ``keys`` where a key may be hot on both sides.

    A key with more than a HOT_SHARE-th of the rows of a side is hot, so there are fewer than 2 * HOT_SHARE such keys
    and they are broadcast. The l x r pairs of a hot key are made by a grid of tasks: either side is cut into parts of
    about ``per_cell`` rows, and each part is copied to the parts of the other side. All other keys meet in one cell.
    Both sides are read twice: give written tables.
    """
    sizes = None
    for side, name in ((left, "_nl"), (right, "_nr")):
        n = side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        total = n.agg(F.sum(name)).first()[0] or 0
        n = n.where(F.col(name) > F.lit(max(per_cell, total / HOT_SHARE)))
        sizes = n if sizes is None else sizes.join(n, keys, "full_outer")
    parts = lambda name: F.greatest(F.lit(1), F.ceil(F.coalesce(name, F.lit(0)) / F.lit(per_cell))).cast("int")
    grid = F.broadcast(sizes.select(*keys, parts("_nl").alias("_pl"), parts("_nr").alias("_pr")))

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        columns = side.columns
        known = side.join(grid, keys, "left").na.fill(1, ["_pl", "_pr"])
        cell = F.pmod(F.xxhash64(*columns), F.col(f"_p{own}")).cast("int")
        return known.select(*columns, cell.alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.col(f"_p{other}") - 1)).alias(f"_{other}"))

    return placed(left, "l", "r").join(placed(right, "r", "l"), [*keys, "_l", "_r"]).drop("_l", "_r")


def prefix_mark(rows: DataFrame, groups: list[str], key: str, weight: str, budgets: DataFrame, budget: str, buckets_log2: int = 16) -> DataFrame:
    """Rows of the groups that have a budget, with ``_in``: whether they stand in the prefix that fits into it.

    The order is that of the 64-bit hash ``key`` (unsigned). A row is in if the weights up to and with its own do not
    exceed the budget. The prefix sums are distributed: weights are summed by range of the key (2^buckets_log2 ranges
    a group), the sums run over the ranges, and only the range in which the budget ends is sorted row by row.
    ``budgets`` has one row a group (as many groups as there are targets: it is broadcast). Rows of one group with the
    same key are ordered by nothing else, so make the key unique by hashing the row's id. The columns of ``budgets``
    are added; no other row is shuffled.
    """
    cell = F.shiftrightunsigned(F.col(key), 64 - buckets_log2)
    sized = rows.join(F.broadcast(budgets), groups, "inner").withColumn("_cell", cell)
    sums = sized.groupBy(*groups, "_cell").agg(F.sum(weight).alias("_w"), F.first(budget).alias("_b"))
    run = Window.partitionBy(*groups).orderBy("_cell")
    cut = (
        sums.withColumn("_to", F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_to") > F.col("_b"))
        .groupBy(*groups)
        .agg(F.min(F.struct("_cell", (F.col("_to") - F.col("_w")).alias("_before"))).alias("_cut"))
    )
    placed = sized.join(F.broadcast(cut), groups, "left")
    same = F.col("_cell") == F.col("_cut._cell")
    outside = placed.where(F.coalesce(~same, F.lit(True))).withColumn("_in", F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut._cell")))
    order = Window.partitionBy(*groups).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(same).withColumn("_in", F.sum(weight).over(order) + F.col("_cut._before") <= F.col(budget))
    return outside.unionByName(inside).drop("_cell", "_cut")


def prefix_cut(rows: DataFrame, groups: list[str], key: str, weight: str, budgets: DataFrame, budget: str, buckets_log2: int = 16) -> DataFrame:
    """The rows of ``prefix_mark`` that are in, without further columns."""
    return prefix_mark(rows, groups, key, weight, budgets.select(*groups, budget), budget, buckets_log2).where("_in").drop("_in", budget)


def take_hashed(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """Exactly k rows (all if there are fewer), those with the smallest 64-bit hash; k may be as large as the data.

    A limit after a sort would merge k rows on the driver; here the cut is found from counts by range of the hash.
    """
    one = rows.withColumn("_all", F.lit(0)).withColumn("_key", key).withColumn("_one", F.lit(1).cast("bigint"))
    budget = rows.sparkSession.createDataFrame([(0, k)], "_all int, _budget bigint")
    return prefix_cut(one, ["_all"], "_key", "_one", budget, "_budget").drop("_all", "_key", "_one")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """unionByName over a list."""
    return functools.reduce(DataFrame.unionByName, frames)
