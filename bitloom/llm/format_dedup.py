"""Records that differ only in spacing, letter case, punctuation or the order of their two texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.codepoints import equal_folded, folded_hashes
from bitloom.operators.skew import join_by_counts, salted_join
from bitloom.scratch import materialise


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, left, right = batch.columns
        a, has_a = folded_hashes(left.to_pylist())
        b, has_b = folded_hashes(right.to_pylist())
        keep = has_a & has_b
        ids = ids.filter(pa.array(keep))
        low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        yield pa.RecordBatch.from_arrays([ids, pa.array(low), pa.array(high)], ["id", "k1", "k2"])


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.to_pydict()
        straight = equal_folded(t["a"], t["ra"]) & equal_folded(t["b"], t["rb"])
        rest = np.flatnonzero(~straight)
        pick = lambda c: [t[c][i] for i in rest]
        straight[rest] = equal_folded(pick("a"), pick("rb")) & equal_folded(pick("b"), pick("ra"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "rep", "k1", "k2")), pa.array(straight)], ["id", "rep", "k1", "k2", "same"])


def format_duplicates(records: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """One row for each record that repeats an earlier one: ``id``, ``rep`` (the smallest id of its set).

    Two records are alike if their two texts, reduced to lower-case letters and digits, are the same two strings in
    either order. Records without a letter in one of the texts (null, empty, signs only) are like no other. Repeated
    rows of one id are one record.

    The texts are streamed through a skip-and-fold table into polynomial hashes, never building the reduced strings;
    only ids and hashes are grouped (with partial sums, so a group of a third of all rows is one row for each map
    task). Then each repeated record is compared with the first of its group by two pointers that skip. Records that only share the hash start the next
    round among themselves, until none is left, so the result is exact.
    """
    base = records.select(F.col(id_col).alias("id"), F.col(left).alias("a"), F.col(right).alias("b"))
    id_type = dict(base.dtypes)["id"]
    pending = materialise(base.mapInArrow(_hash_batches, f"id {id_type}, k1 bigint, k2 bigint"))
    total, found = None, None
    while True:
        groups = pending.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        total = total if total is not None else pending.count()
        members = join_by_counts(pending, groups, ["k1", "k2"], "n", total)
        texts = materialise(base.join(members, "id", "inner"))  # of repeated records only, for both sides of the comparison
        heads = texts.where("id = rep").select("rep", "n", F.col("a").alias("ra"), F.col("b").alias("rb"))
        pairs = salted_join(texts.where("id <> rep"), heads, "rep", "n", F.col("id"))
        pairs = pairs.select("id", "rep", "k1", "k2", "a", "b", "ra", "rb")
        checked = materialise(pairs.mapInArrow(_compare_batches, f"id {id_type}, rep {id_type}, k1 bigint, k2 bigint, same boolean"))
        good = checked.where("same").select("id", "rep")
        found = good if found is None else found.unionByName(good)
        failed = checked.where("not same")
        if failed.isEmpty():
            return found.distinct()
        pending = failed.select("id", "k1", "k2")


def collapse_formats(records: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """One record of each set of alike records (the one with the smallest id) with ``n_copies``, the size of its set.

    Records that are like no other keep n_copies 1; all columns of the table stay (a column n_copies is replaced).
    """
    twins = materialise(format_duplicates(records, id_col, left, right))
    sizes = twins.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("__copies")).withColumnRenamed("rep", id_col)
    rows = records.join(twins.select(F.col("id").alias(id_col)), id_col, "left_anti").join(sizes, id_col, "left")
    return rows.withColumn("n_copies", F.coalesce("__copies", F.lit(1).cast("bigint"))).drop("__copies")
