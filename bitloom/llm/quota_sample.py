"""A sample whose shares of the categories match targets, with a floor for small categories."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import folded_name
from bitloom.operators.skew import prefix_cut
from bitloom.scratch import materialise

#: The driver holds two numbers for each target row; more targets than this are refused.
MAX_TARGETS = 100_000


def _spread(take: dict, room: dict, lack: dict, amount: int, sign: int) -> None:
    """Move ``amount`` rows into (sign 1) or out of (sign -1) the categories: first what each lacks, then in proportion to the room."""
    for c in sorted(take, key=lambda c: (-lack[c], c)):
        n = min(amount, room[c], max(0, int(lack[c])))
        take[c] += sign * n
        room[c] -= n
        amount -= n
    total = sum(room.values())
    for c in sorted(take):
        n = min(room[c], -(-amount * room[c] // total)) if amount and total else 0
        take[c] += sign * n
        total -= room[c]
        amount -= n


def swap_repair(available: dict, floors: dict, wanted: dict, size: int, start: dict) -> dict:
    """How many rows of each category to take, by repairing a random sample that keeps the floors.

    available: rows that exist; floors: least number; wanted: number by the target share; size: size of the sample;
    start: rows of each category in a random sample. The start is raised to min(floor, available) and brought to the
    size. Then rows are exchanged between the signatures (here: categories) with the largest surplus and the largest
    lack, as many at a time as lower the summed deviation, until no exchange lowers it; an exchange settles one of
    the two, so there are about as many exchanges as categories. Floors that exceed the size together win over it.
    """
    least = {c: min(floors[c], available[c]) for c in wanted}
    take = {c: min(available[c], max(least[c], start.get(c, 0))) for c in wanted}
    missing = min(size, sum(available.values())) - sum(take.values())
    if missing > 0:
        _spread(take, {c: available[c] - take[c] for c in take}, {c: wanted[c] - take[c] for c in take}, missing, 1)
    elif missing < 0:
        room = {c: take[c] - least[c] for c in take}
        _spread(take, room, {c: take[c] - wanted[c] for c in take}, min(-missing, sum(room.values())), -1)
    over = [(wanted[c] - take[c], c) for c in take if take[c] > least[c]]
    under = [(take[c] - wanted[c], c) for c in take if take[c] < available[c]]
    heapq.heapify(over)
    heapq.heapify(under)
    while over and under:
        (s, a), (lack, b) = over[0], under[0]
        s, lack = -s, -lack
        if a == b or min(s, lack) <= 0 or s + lack <= 1 + 1e-9:
            return take
        n = max(1, int(min(s, lack, take[a] - least[a], available[b] - take[b])))
        take[a] -= n
        take[b] += n
        heapq.heappop(over)
        heapq.heappop(under)
        if take[a] > least[a]:
            heapq.heappush(over, (wanted[a] - take[a], a))
        if take[b] < available[b]:
            heapq.heappush(under, (take[b] - wanted[b], b))
    return take


def _goals(targets: DataFrame) -> DataFrame:
    named = targets.withColumn("category", folded_name(F.col("domain"))).where("category is not null and plan_id is not null")
    return named.dropDuplicates(["plan_id", "category"]).select("plan_id", "domain", "category", "target_share", "min_rows", "sample_share")


def quota_sample(records: DataFrame, id_col: str, category: str, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of all plans.

    sample: ``plan_id``, the id, ``category``; report, a row for each target: ``plan_id, domain, target_share, min_rows,
    available, needed, taken, met, short``. ``taken`` is counted in the sample itself; ``needed`` is the greater of the
    floor and the share of the sample; ``met``: not more than rounding is missing; ``short``: missed because the
    category has too few records. A row that is neither was pushed aside by the floors of other categories.

    Records of each plan stand in the order of a hash of plan and id. The random start is what lies below the
    sample's share in that order; it is counted by plan and category (partial sums first), swap_repair works on the
    counts, and the sample is materialised as a prefix of each category in the same order: start rows stay unless
    they are swapped out. The cut is found from counts by range of the hash, so no category is sorted in one task.

    Names compare in lower case without outer blanks. Repeated target rows count once; a null category of a record
    belongs to no category; targets without plan or category are left out; null shares and floors count as 0; repeated
    rows of an id are records of their own; an empty table of records gives available 0 everywhere.
    """
    spark = records.sparkSession
    goals = _goals(targets)
    asked = goals.limit(MAX_TARGETS + 1).collect()
    if len(asked) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    rows = records.select(F.col(id_col), folded_name(F.col(category)).alias("category")).where("category is not null")
    total = rows.count()
    share = {}
    for g in asked:
        share[g["plan_id"]] = max(share.get(g["plan_id"], 0.0), g["sample_share"] or 0.0)
    plans = spark.createDataFrame([(g["plan_id"], g["category"], share[g["plan_id"]]) for g in asked], "plan_id string, category string, _share double")
    keyed = rows.join(F.broadcast(plans), "category").withColumn("_key", F.xxhash64(F.lit(seed), "plan_id", F.col(id_col)))
    drawn = F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53)) < F.col("_share")
    counted = {(r["plan_id"], r["category"]): (r["n"], r["m"]) for r in keyed.groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(drawn).alias("m")).collect()}
    budgets, report = [], []
    for plan in sorted(share):
        own = sorted((g for g in asked if g["plan_id"] == plan), key=lambda g: g["category"])
        available = {g["category"]: counted.get((plan, g["category"]), (0, 0))[0] for g in own}
        start = {g["category"]: counted.get((plan, g["category"]), (0, 0))[1] for g in own}
        floors = {g["category"]: g["min_rows"] or 0 for g in own}
        wanted = {g["category"]: (g["target_share"] or 0.0) * share[plan] * total for g in own}
        take = swap_repair(available, floors, wanted, int(share[plan] * total + 0.5), start)
        for g in own:
            c = g["category"]
            budgets.append((plan, c, take[c]))
            report.append((plan, g["domain"], c, g["target_share"], g["min_rows"], available[c], max(float(floors[c]), wanted[c])))
    limits = spark.createDataFrame(budgets, "plan_id string, category string, _budget bigint")
    one = keyed.drop("_share").withColumn("_one", F.lit(1).cast("bigint"))
    sample = prefix_cut(one, ["plan_id", "category"], "_key", "_one", limits, "_budget").select("plan_id", id_col, "category")
    base = spark.createDataFrame(report, "plan_id string, domain string, category string, target_share double, min_rows bigint, available bigint, needed double")
    taken = sample.groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("taken"))
    joined = base.join(F.broadcast(taken), ["plan_id", "category"], "left").drop("category").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    missed = F.col("taken") < F.col("needed")
    return sample, joined.withColumns({"met": F.col("taken") + 1 > F.col("needed"), "short": missed & (F.col("available") < F.col("needed"))})


def sample_sizes(records: DataFrame, id_col: str, category: str, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``plan_id, n_rows, n_ids, floors_kept``: the size of each plan's sample, its different ids, and whether every
    category has its floor or all that exists."""
    sample, report = quota_sample(records, id_col, category, targets, seed)
    ids = materialise(sample).groupBy("plan_id").agg(F.countDistinct(id_col).alias("n_ids"))
    per = report.groupBy("plan_id").agg(F.sum("taken").alias("n_rows"), F.bool_and(F.col("taken") >= F.least(F.coalesce("min_rows", F.lit(0)), "available")).alias("floors_kept"))
    return per.join(F.broadcast(ids), "plan_id", "left").select("plan_id", "n_rows", F.coalesce("n_ids", F.lit(0).cast("bigint")).alias("n_ids"), "floors_kept")
