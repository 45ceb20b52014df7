"""Joins of corpora: by position, against benchmarks, between similar or related rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.hashing import hash_int, hash_unit
from bitloom.functions.trees import let
from bitloom.operators.skew import join_by_counts, take_hashed
from bitloom.scratch import materialise

#: Mean number of partners drawn by one random number; rows with a larger mean use several. Eight times as many never occur.
MOST_DRAWN = 8


def zip_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows at the same position of two files; what only one of them has is left out."""
    return left.join(right, on, "inner")


def _hashed(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows with ``_k``, a digest of the join columns (null if one of them is), so that long texts are not shuffled as keys."""
    key = F.sha2(F.concat(*(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in on)), 256)
    return rows.withColumn("_k", key)


def overlap(rows: DataFrame, other: DataFrame, on: list[str], keep_multiplicity: bool = False) -> DataFrame:
    """Rows that also stand in ``other``; with keep_multiplicity once for each time they stand there.

    ``other`` is reduced to its different keys, with their number, before anything meets, so a key is hot in ``rows``
    only, and Spark divides such a partition of the left side at run time (adaptive skew join). Rows with a null key
    stand nowhere.
    """
    asked = _hashed(other.select(*on), on).where("_k is not null").groupBy("_k").agg(F.count(F.lit(1)).alias("_times"))
    keyed = _hashed(rows, on).where("_k is not null")
    if not keep_multiplicity:
        return keyed.join(asked.select("_k"), "_k", "left_semi").drop("_k")
    found = keyed.join(asked, "_k").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return found.drop("_k", "_times", "_copy")


def without_overlap(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows that do not stand in ``other`` (rows with a null key never do, and are not shuffled). See overlap."""
    asked = _hashed(other.select(*on), on).where("_k is not null").select("_k").distinct()
    keyed = _hashed(rows, on)
    kept = keyed.where("_k is not null").join(asked, "_k", "left_anti")
    return kept.select(*rows.columns).unionByName(keyed.where("_k is null").select(*rows.columns))


def outer_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join of two tables of counts, with 0 for what one of them lacks."""
    joined = left.join(right, on, "full_outer")
    return joined.na.fill(0, [c for c in joined.columns if c != on])


def links_within(rows: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """``id, class_id, n_links``: each row's class (the smallest id of its group) and the number of other rows in it.

    This stands for all pairs within the groups without writing them. Rows with a null in the group have no links.
    """
    slim = materialise(rows.select(*group, id_col))
    groups = slim.groupBy(*group).agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("_n"))
    sized = join_by_counts(slim, groups, group, "_n", slim.count())
    return sized.select(F.col(id_col).alias("id"), "class_id", (F.col("_n") - 1).alias("n_links"))


def numbered(rows: DataFrame, id_col: str, seed: int, *within: str) -> DataFrame:
    """Rows with ``pos``, their place (from 0; in each group if ``within`` is given) in a random order by seed and id.

    The places are built from counts by range of a hash (2^16 ranges), so neither all rows nor a large group are ever
    sorted in one task.
    """
    keyed = rows.withColumn("_k", hash_int(seed, "pos", F.col(id_col))).withColumn("_cell", F.shiftright(F.col("_k"), 16))
    cells = [*within, "_cell"]
    sums = keyed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*within).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^16 rows a group
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*cells).orderBy("_k", id_col)
    placed = keyed.join(before if within else F.broadcast(before), cells)
    return placed.withColumn("pos", F.col("_before") + F.row_number().over(inner) - 1).drop("_k", "_cell", "_before")


def _poisson(b: Column) -> Column:
    """A Poisson number from the fields ``u`` (uniform) and ``mean``, by inversion."""
    first = F.struct(F.exp(-b["mean"]).alias("term"), F.exp(-b["mean"]).alias("sum"), F.lit(0).alias("n"))
    step = lambda c, i: F.when(b["u"] < c["sum"], c).otherwise(F.struct((c["term"] * b["mean"] / i).alias("term"), (c["sum"] + c["term"] * b["mean"] / i).alias("sum"), i.alias("n")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8 * MOST_DRAWN)), first, step)["n"]


def sampled_combinations(rows: DataFrame, group: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """``pair_a, pair_b`` (a < b): k random unordered pairs of rows of the same group, uniformly over all such pairs.

    All of them if there are at most k. Otherwise each row draws a Poisson number of partners among the rows behind it
    in its group's random order, so many that more than k different pairs are expected, of which k are kept by hash;
    so about as many pairs are made as are wanted, however large a group is. Should fewer be different, more are
    drawn. If more than half of all pairs are wanted, all are made first (at most about 2k).
    """
    base = materialise(rows.select(*group, id_col).dropna(subset=group))
    n_rows = base.count()
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    total = sizes.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()[0] or 0
    placed = numbered(join_by_counts(base, sizes, group, "_n", n_rows), id_col, seed, *group)
    other = placed.select(*group, F.col("pos").alias("_to"), F.col(id_col).alias("_b"))
    ahead = F.col("_n") - 1 - F.col("pos")
    wanted = k + 4 * k**0.5 + 16

    def pairs_of(drawn: DataFrame) -> DataFrame:
        return drawn.join(other, [*group, "_to"]).select(F.least(id_col, "_b").alias("pair_a"), F.greatest(id_col, "_b").alias("pair_b")).distinct()

    while 2 * wanted < total:
        # with t draws in the mean, total * (1 - exp(-t / total)) of all pairs are drawn at least once
        mean = ahead * F.lit(-math.log1p(-wanted / total))
        parts = F.greatest(F.lit(1), F.ceil(mean / MOST_DRAWN)).cast("int")
        split = placed.where(ahead > 0).withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
        one, u = mean / F.col("_parts"), hash_unit(seed, "partners", F.col(id_col), F.col("_part"))
        times = let(F.struct(u.alias("u"), one.alias("mean")), _poisson)
        several = split.withColumn("_t", F.explode(F.filter(F.sequence(F.lit(0), times), lambda i: i > 0)))
        pairs = materialise(pairs_of(several.withColumn("_to", F.col("pos") + 1 + F.pmod(hash_int(seed, "partner", F.col(id_col), F.col("_part"), F.col("_t")), ahead))))
        if pairs.count() >= k:
            break
        wanted *= 1.5
    else:
        pairs = pairs_of(placed.where(ahead > 0).withColumn("_to", F.explode(F.sequence(F.col("pos") + 1, F.col("_n") - 1))))
    return take_hashed(pairs, F.xxhash64(F.lit(seed), "pair_a", "pair_b"), k)


def draw_pairs(n: int, k: int, seed: int, spark) -> DataFrame:  # noqa: ANN001
    """``draw, x, y``: k distinct ordered pairs of places x != y below n, uniformly; at most n(n-1).

    Draws are hashes of their number; the first k different ones count, however many are made. If more than half of
    all pairs are wanted, all are ranked by hash instead.
    """
    most = n * (n - 1)
    k = min(k, most)
    schema = "draw bigint, x bigint, y bigint"
    if k <= 0:
        return spark.createDataFrame([], schema)
    if 2 * k > most:
        every = spark.range(most).select((F.col("id") / (n - 1)).cast("bigint").alias("x"), F.pmod("id", F.lit(n - 1)).alias("y0"))
        every = every.select("x", (F.col("y0") + (F.col("y0") >= F.col("x")).cast("bigint")).alias("y"))
        every = every.select((F.col("x") * n + F.col("y")).alias("draw"), "x", "y")
        return take_hashed(every, F.shiftleft(hash_int(seed, "every", F.col("draw")), 32).bitwiseOR(F.pmod("draw", F.lit(1 << 32))), k)
    m = k + max(64, k)
    while True:
        draws = spark.range(m).select(
            F.col("id").alias("draw"),
            F.pmod(hash_int(seed, "x", F.col("id")), F.lit(n)).alias("x"),
            F.pmod(hash_int(seed, "y", F.col("id")), F.lit(n - 1)).alias("y0"),
        )
        pairs = draws.select("draw", "x", (F.col("y0") + (F.col("y0") >= F.col("x")).cast("bigint")).alias("y"))
        firsts = materialise(pairs.groupBy("x", "y").agg(F.min("draw").alias("draw")).select("draw", "x", "y"))
        if firsts.count() >= k:
            # numbers from 0, as the top bits of a 64-bit key cut in their order
            return take_hashed(firsts, F.shiftleft("draw", 63 - m.bit_length()), k)
        m *= 2


def sampled_pairs(pool: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """``draw, pair_a, pair_b``: k random ordered pairs of different members of the pool. Two equi-joins, no cross join."""
    ids = materialise(pool.select(id_col))
    members = numbered(ids, id_col, seed)
    pairs = draw_pairs(ids.count(), k, seed, pool.sparkSession)
    left = members.select(F.col("pos").alias("x"), F.col(id_col).alias("pair_a"))
    right = members.select(F.col("pos").alias("y"), F.col(id_col).alias("pair_b"))
    return pairs.join(left, "x").join(right, "y").select("draw", "pair_a", "pair_b")
