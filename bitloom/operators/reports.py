"""Reports that pair predictions and augmented sentences with their originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_predictions(originals: DataFrame, predictions: DataFrame, n_best: int) -> DataFrame:
    """``line_no, original, predictions``: each original line with its n_best predicted lines, in order.

    Both tables have ``line_no`` (from 0) and ``value``; the predictions must be exactly n_best times as many.
    """
    n, m = originals.count(), predictions.count()
    if m != n * n_best:
        raise ValueError(f"{m} predictions for {n} lines are not {n_best} each")
    keyed = predictions.select(F.floor(F.col("line_no") / n_best).cast("bigint").alias("line_no"), F.struct("line_no", "value").alias("p"))
    grouped = keyed.groupBy("line_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return originals.select("line_no", F.col("value").alias("original")).join(grouped, "line_no").select("line_no", "original", F.transform("p", lambda x: x["value"]).alias("predictions"))


def report_blocks(augmented: DataFrame, originals: DataFrame) -> DataFrame:
    """``method, pair_a, pair_b, report``: two original pairs, a rule, the two augmented pairs, a rule.

    augmented: rows of slots 0 and 1; originals: ``pair_id, src, tgt``.
    """
    line = F.concat_ws("\t", "src", "tgt")
    both = augmented.groupBy("method", "draw", "pair_a", "pair_b").agg(F.max(F.when(F.col("slot") == 0, line)).alias("first"), F.max(F.when(F.col("slot") == 1, line)).alias("second"))
    text = originals.select("pair_id", line.alias("line"))
    a = text.select(F.col("pair_id").alias("pair_a"), F.col("line").alias("la"))
    b = text.select(F.col("pair_id").alias("pair_b"), F.col("line").alias("lb"))
    rule = F.lit("-" * 20)
    return both.join(a, "pair_a").join(b, "pair_b").select("method", "pair_a", "pair_b", F.concat_ws("\n", "la", "lb", rule, "first", "second", rule).alias("report"))
