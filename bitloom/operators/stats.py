"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.99, 0.999)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """``by``, ``n`` and ``share`` of all rows; null is a group of its own."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("_total")).alias("share"))  # total is one row


def _long(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by``, ``column_name``, ``x``: the values of all columns as doubles, from one scan."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
    return rows.select(*by, F.inline(F.array(*cells)))


def _ranked(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by``, ``column_name``, ``x``, ``_n``: the different values with their number, ``_to``: values up to and with them, ``n``, ``mean``: of the group.

    All columns come from one scan, and equal values are counted before the shuffle. The running sums go over the
    sorted different values of a group, which are sorted with spilling and never held in the state of an aggregate.
    """
    keys = [*by, "column_name"]
    counts = _long(rows, by, columns).where("x is not null").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("x")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("_n").over(whole)
    return counts.select("*", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"), total.alias("n"), (F.sum(F.col("x") * F.col("_n")).over(whole) / total).alias("mean"))


def _quantiles(quantiles: tuple[float, ...]) -> tuple[list[Column], list[Column]]:
    """Aggregates over rows of _ranked, and from these the quantiles ``q0``, ``q1``, .. with linear interpolation."""
    found, between = [], []
    for i, p in enumerate(quantiles):
        at = (F.col("n") - 1) * F.lit(float(p))
        for name, rank in ((f"_a{i}", F.floor(at)), (f"_b{i}", F.ceil(at))):
            found.append(F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n")), F.col("x"))).alias(name))
        between.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (at - F.floor(at))).alias(f"q{i}"))
    return found, between


def exact_quantiles(rows: DataFrame, by: list[str], columns: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """``by``, ``column_name``, ``n`` and ``q0``, ``q1``, ..: exact quantiles with linear interpolation, nulls left out (see _ranked)."""
    keys = [*by, "column_name"]
    found, between = _quantiles(quantiles)
    return _ranked(rows, by, columns).groupBy(*keys).agg(F.max("n").alias("n"), *found).select(*keys, "n", *between)


def describe(rows: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row a column: count, mean, both standard deviations, min, max and the exact quantiles as ``q<per mille>``.

    Everything comes from the counted values of one scan, however many columns there are.
    """
    found, between = _quantiles(quantiles)
    squares = F.sum(F.col("_n") * F.pow(F.col("x") - F.col("mean"), 2))
    one = _ranked(rows, [], columns).groupBy("column_name").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), squares.alias("_s"), F.min("x").alias("lowest"), F.max("x").alias("highest"), *found)
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    full = every.join(F.broadcast(one), "column_name", "left")  # one row a column
    std = [F.sqrt(F.try_divide(F.col("_s"), F.col("n") - d)).alias(name) for d, name in ((1, "std_sample"), (0, "std_population"))]
    named = [q.alias(f"q{round(p * 1000)}") for q, p in zip(between, quantiles, strict=True)]
    return full.select("column_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean", *std, "lowest", "highest", *named)


def ngram_counts(texts: DataFrame, column: str, n: int) -> DataFrame:
    """``ngram``, ``n``, ``cnt``: lower-case n-grams of words between white space, within each text. Counted map-side first."""
    words = F.split(T.strip_all(F.lower(F.col(column))), f"{T.WS}+")
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("_w"), i, n), " "))
    rows = texts.select(words.alias("_w")).where((F.size("_w") >= n) & (F.col("_w")[0] != ""))
    return rows.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt")).select("ngram", F.lit(n).alias("n"), "cnt")


def forbidden_histogram(texts: DataFrame, column: str, top: int = 50) -> DataFrame:
    """``character``, ``cnt``: the most frequent characters outside the clean set (a top list, ties by character)."""
    chars = texts.select(F.explode(T.forbidden_chars(F.col(column))).alias("character"))
    return chars.groupBy("character").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "character").limit(top)


def conditional_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: for each name the number of rows where its condition holds."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def sweep(rows: DataFrame, a: Column, b: Column, ratios: list[float], cutoffs: list[int]) -> DataFrame:
    """``ratio``, ``cutoff``, ``kept``: share of rows that a length filter would keep, over a grid of its limits.

    The grid (ratios x cutoffs) is a literal array: the rows are read once and not multiplied, one aggregate a cell.
    """
    slim = rows.select(a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null")
    ratio = F.greatest(T.length_ratio(F.col("_a"), F.col("_b")), T.length_ratio(F.col("_b"), F.col("_a")))
    ratio = F.when((F.col("_a") > 0) & (F.col("_b") > 0), ratio)
    cells = [(r, c) for r in ratios for c in cutoffs]
    kept = [F.avg(((F.abs(F.col("_a") - F.col("_b")) < c) | F.coalesce(ratio < r, F.lit(False))).cast("double")).alias(f"k{i}") for i, (r, c) in enumerate(cells)]
    wide = slim.agg(*kept)
    grid = F.array(*(F.struct(F.lit(r).alias("ratio"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("kept")) for i, (r, c) in enumerate(cells)))
    return wide.select(F.inline(grid))


def equal_width_bins(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` (1 .. bins), ``n``: bins of equal width over the range, closed on the right; the lowest value is in the first."""
    x = F.col(column).cast("double")
    limits = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = F.ceil((x - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))).cast("int")
    one = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), place)))
    binned = rows.where(x.isNotNull()).crossJoin(F.broadcast(limits))  # limits are one row
    return binned.groupBy(one.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b``, ``r``: Pearson correlation of every pair of columns (a before b), rows with a null in the pair left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def baseline_difference(rows: DataFrame, group: str, order: str, kind: str, base: str, value: str) -> DataFrame:
    """Rows with ``difference``: their value minus that of the last base row before them in their group (null before the first)."""
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(kind) == base, F.col(value)), ignorenulls=True).over(run)
    return rows.withColumn("difference", F.col(value) - last)


def duplicate_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` with the number of their copies; nulls are equal to each other here."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
