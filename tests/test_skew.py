"""Joins and cuts under hot keys."""

import random

from pyspark.sql import functions as F

from bitloom.operators import skew
from bitloom.operators.skew import join_by_counts, many_to_many_join, prefix_cut, prefix_mark, salted_join


def test_prefix_cut_takes_the_exact_prefix(spark):
    rng = random.Random(2)
    data = [(g, i, rng.randrange(-(1 << 63), 1 << 63), rng.randint(0, 9)) for g in "abc" for i in range(300)]
    rows = spark.createDataFrame(data, "g string, i bigint, k bigint, w bigint")
    budgets = spark.createDataFrame([("a", 400), ("b", 0), ("c", 10**9)], "g string, b bigint")
    got = {(r.g, r.i) for r in prefix_cut(rows, ["g"], "k", "w", budgets, "b", buckets_log2=3).collect()}
    for g, b in (("a", 400), ("b", 0), ("c", 10**9)):
        total, want = 0, set()
        for _, i, _, w in sorted((x for x in data if x[0] == g), key=lambda x: x[2] % (1 << 64)):
            total += w
            if total <= b:
                want.add((g, i))
        assert {x for x in got if x[0] == g} == want


def test_skewed_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    big = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i bigint, k bigint")
    keyed = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_by_counts(big, keyed, ["k"], "n", 300).count() == 300
    counted = big.join(keyed, "k")
    assert salted_join(counted, keyed, "k", "n", F.col("i"), per_copy=20).count() == 300


def test_many_to_many_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    left = spark.createDataFrame([(i, 0 if i % 3 else i, 1) for i in range(90)] + [(500, None, 1)], "i bigint, k bigint, v int")
    right = spark.createDataFrame([(j, 0 if j % 2 else j, 2) for j in range(60)] + [(j, 3, 2) for j in range(40)], "j bigint, k bigint, w int")
    got = many_to_many_join(left, right, ["k"], per_cell=7)
    want = left.join(right, "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert many_to_many_join(left.limit(0), right, ["k"]).count() == 0


def test_prefix_mark_keeps_all_rows(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), "id", F.xxhash64("id").alias("k"), F.lit(2).cast("bigint").alias("w"))
    budgets = spark.createDataFrame([("g", 301, 5)], "g string, b bigint, extra int")
    got = prefix_mark(rows, ["g"], "k", "w", budgets, "b")
    assert got.count() == 1000 and got.where("_in").count() == 150
    assert "extra" in got.columns
