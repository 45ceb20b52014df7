"""Samples and splits whose random choice depends on seed and ids only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.hashing import hash_key, hash_unit


def sample_per_group(rows: DataFrame, group: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """k rows of each group, without replacement, by the order of a hash.

    Spark turns rank <= k into a limit before the shuffle (WindowGroupLimit), so a hot group sends k rows a task.
    """
    order = Window.partitionBy(*group).orderBy(hash_key(seed, "sample", F.col(id_col)), id_col)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def split_by_group(rows: DataFrame, group: str, id_col: str, n_test: int, n_valid: int, seed: int) -> DataFrame:
    """Rows with ``new_split``: of each group n_test rows to test, the next n_valid to valid, the rest to train.

    Only the first n_test + n_valid rows of each group are ranked (a limit before the shuffle); the others are train
    without being sorted.
    """
    order = Window.partitionBy(group).orderBy(hash_key(seed, "split", F.col(id_col)), id_col)
    held = rows.select(group, id_col).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_test + n_valid).select(id_col, "_r")
    label = F.when(F.col("_r").isNull(), "train").when(F.col("_r") <= n_test, "test").otherwise("valid")
    return rows.join(held, id_col, "left").withColumn("new_split", label).drop("_r")


def split_by_share(rows: DataFrame, id_col: str, valid_share: float, seed: int) -> DataFrame:
    """Rows with ``new_split``: valid with the given probability, else train; no shuffle."""
    return rows.withColumn("new_split", F.when(hash_unit(seed, "share", F.col(id_col)) < valid_share, "valid").otherwise("train"))


#: Mean number of draws that one hash of a row stands for.
MEAN_A_HASH = 32.0


def poisson_steps(mean: float) -> list[float]:
    """Chances of at most 0, 1, 2, .. draws, as far as a number of 32 bits can tell them from 1."""
    term = total = math.exp(-mean)
    out = [total]
    while total < 1 - 2.0**-32 and term > 0:
        term *= mean / len(out)
        total += term
        out.append(total)
    return out


def sample_with_replacement(rows: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """Each row as often as it is drawn in a sample with replacement of about share * rows draws, with ``copy`` from 1.

    A row's number of draws is Poisson with mean ``share`` (the limit of drawing with replacement), from one hash a
    row (several for a large share), so the sample needs no counting and no shuffle.
    """
    parts = max(1, math.ceil(share / MEAN_A_HASH))
    steps = F.array(*map(F.lit, poisson_steps(share / parts)))
    times = F.lit(0)
    for p in range(parts):
        u = hash_unit(seed, f"again{p}" if p else "again", F.col(id_col))
        times = times + F.size(F.filter(steps, lambda s: s <= u))  # noqa: B023
    return rows.withColumn("_n", times).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def batches(rows: DataFrame, index: str, size: int, skip: int = 0) -> DataFrame:
    """Rows with ``batch``, the number of their batch of ``size`` by a line index from 0; the first ``skip`` batches left out."""
    return rows.withColumn("batch", F.floor(F.col(index) / size).cast("bigint")).where(F.col("batch") >= skip)


def mini_batches(rows: DataFrame, index: str, k: int, total: int) -> DataFrame:
    """Rows with ``mini_batch`` (0 .. k-1): chunks of ceil(total / k) rows in order; the last ones may be short or empty."""
    size = max(1, -(-total // k))
    return rows.withColumn("mini_batch", F.floor(F.col(index) / size).cast("bigint"))
