"""Splits that keep all records of related sources together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import folded_name
from bitloom.operators.skew import join_by_counts
from bitloom.scratch import discard, materialise

# fixed values: entries that name nobody
PLACEHOLDERS = ("", "unknown", "n/a", "-", "ismeretlen", "various")

#: Records without a source form so many components by hash.
FREE_COMPONENTS = 1024
#: The driver holds one number for each split and label; more are refused.
MAX_CELLS = 1_000_000
#: Components of one annealing block.
BLOCK = 4000


def name_or_null(c: Column) -> Column:
    """Lower case without outer blanks; null for entries that name nobody."""
    n = folded_name(c)
    return F.when(~n.isin(*PLACEHOLDERS), n)


def file_key(c: Column) -> Column:
    """File name in lower case, without directories and outer blanks."""
    return folded_name(F.regexp_replace(folded_name(c), r"^.*[/\\]", ""))


def source_groups(catalog: DataFrame) -> DataFrame:
    """``source_id``, ``group_id``: sources that share an author or a series, also through others; the smallest id.

    Every row of a source counts, also repeated ones. Rows without source_id are left out. Connected components of
    the graph of sources and names: in each round every name takes the smallest label of its sources and every
    source the smallest of its names, and labels are then replaced by the labels of the sources they name (pointer
    jumping), so a chain of n sources takes about log n rounds. Names are aggregated with partial sums, so a name of
    a third of all sources is no hot spot. Each round is cut by a table in the shared folder.
    """
    rows = catalog.where("source_id is not null")
    names = [F.concat(F.lit(k + ":"), name_or_null(F.col(k))) for k in ("author", "series")]
    links = rows.select("source_id", F.explode(F.array(*names)).alias("name")).where("name is not null").distinct()
    links = materialise(links)
    shared = links.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_links = links.count()
    links = materialise(join_by_counts(links, shared, ["name"], "n", n_links))
    labels = table = materialise(rows.select("source_id").distinct().withColumn("group_id", F.col("source_id")))
    while True:
        seen = links.join(labels, "source_id")
        by_name = seen.groupBy("name").agg(F.min("group_id").alias("m"), F.count(F.lit(1)).alias("n"))
        by_source = join_by_counts(links.drop("n"), by_name, ["name"], "n", n_links).groupBy("source_id").agg(F.min("m").alias("m"))
        step = labels.join(by_source, "source_id", "left").select("source_id", F.col("group_id").alias("old"), F.least("group_id", F.coalesce("m", "group_id")).alias("mid"))
        step = materialise(step)
        # pointer jumping: the label's own label; many sources may point to one, so their labels are grouped first
        pointed = step.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
        target = pointed.join(step.select(F.col("source_id").alias("mid"), F.col("mid").alias("jump")), "mid")
        new = materialise(join_by_counts(step, target, ["mid"], "n", n_links + 1).select("source_id", F.least("mid", "jump").alias("group_id"), "old"))
        discard(step, table)
        table, labels = new, new.select("source_id", "group_id")
        changed = not new.where("group_id <> old").isEmpty()
        if not changed:
            return labels


def source_keys(catalog: DataFrame) -> DataFrame:
    """``source_id``, ``domain_key``, ``file_key`` of each source, once."""
    return (
        catalog.select("source_id", folded_name(F.col("domain")).alias("domain_key"), file_key(F.col("source_file")).alias("file_key"))
        .where("source_id is not null and domain_key is not null and file_key is not null")
        .groupBy("domain_key", "file_key")
        .agg(F.min("source_id").alias("source_id"))
    )


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("domain_key", folded_name(F.col("domain"))).withColumn("file_key", file_key(F.col("source_file")))


def place_records(records: DataFrame, id_col: str, catalog: DataFrame, split_col: str | None = None) -> DataFrame:
    """``id, component, group_id, source_id, domain_key, split``: the component that each record moves with.

    A component is a group of related sources. Records without a source, or with one that the catalog lacks, have no
    group and form FREE_COMPONENTS small components by hash. Records are counted by (domain, file) first; the groups
    are joined to the counted keys, and every record meets its key once, hot keys by broadcast.
    """
    split = F.col(split_col) if split_col else F.lit(None).cast("string")
    slim = _keyed(records.select(F.col(id_col).alias("id"), "domain", "source_file", split.alias("split"))).drop("domain", "source_file")
    keys = ["domain_key", "file_key"]
    named = slim.where("domain_key is not null and file_key is not null")
    used = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sources = source_keys(catalog).join(source_groups(catalog), "source_id")
    table = materialise(used.join(sources, keys, "left").select(*keys, "n", "source_id", "group_id"))
    total = table.agg(F.sum("n")).first()[0] or 0
    bound = join_by_counts(named, table, keys, "n", total).drop("n")
    none = F.lit(None).cast(dict(table.dtypes)["source_id"])
    unbound = slim.where("domain_key is null or file_key is null").withColumns({"source_id": none, "group_id": none})
    free = F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(FREE_COMPONENTS)))
    component = F.coalesce(F.concat(F.lit("g"), "group_id"), free)
    return bound.unionByName(unbound).select("id", component.alias("component"), "group_id", "source_id", "domain_key", "split")


def anneal(begins: np.ndarray, columns: np.ndarray, amounts: np.ndarray, start: np.ndarray, targets: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Assignment of components to splits that brings the amounts near ``targets`` (splits x columns).

    Component i has ``amounts`` of the ``columns`` begins[i] .. begins[i + 1] (column 0: records, others: labels); all
    other columns are 0 and are never touched. A step moves one component or exchanges two; it is taken if the summed
    deviation falls, or with the probability of the falling temperature. Returns the best assignment seen and its
    deviation.
    """
    rng = np.random.default_rng(seed)
    n, k = len(begins) - 1, len(targets)
    diff = -targets.astype(np.float64)
    np.add.at(diff, (np.repeat(start, np.diff(begins)), columns), amounts)
    at, cost = start.copy(), np.abs(diff).sum()
    best, best_cost = at.copy(), cost
    heat = max(1.0, 2 * amounts[columns == 0].mean()) if len(columns) else 1.0

    def shift(i: int, old: int, new: int) -> float:
        c, v = columns[begins[i] : begins[i + 1]], amounts[begins[i] : begins[i + 1]]
        x, y = diff[old, c], diff[new, c]
        diff[old, c], diff[new, c] = x - v, y + v
        return float((np.abs(x - v) - np.abs(x) + np.abs(y + v) - np.abs(y)).sum())

    for i in range(steps if n and k > 1 else 0):
        t = heat * (1 - i / steps) ** 2 + 1e-9
        a = int(rng.integers(n))
        b = int(rng.integers(n)) if rng.random() < 0.5 else a
        old = int(at[a])
        exchange = at[b] != old
        new = int(at[b]) if exchange else (old + 1 + int(rng.integers(k - 1))) % k
        change = shift(a, old, new) + (shift(b, new, old) if exchange else 0.0)
        if change < 0 or rng.random() < np.exp(-change / t):
            at[a] = new
            if exchange:
                at[b] = old
            cost += change
            if cost < best_cost - 1e-9:
                best_cost, best = cost, at.copy()
        else:
            if exchange:
                shift(b, old, new)
            shift(a, new, old)
    return best, float(best_cost)


def _block_search(lack, seed: int, turn: int, steps: int):  # noqa: ANN001, ANN202
    """The search of one block by one replica; lack: broadcast (number of each label, what each split lacks of each column)."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        number, missing = lack.value
        pdf = pdf.sort_values("component").reset_index(drop=True)
        own = [[(0, float(s)), *((number[e["label"]], e["n"] / 2) for e in sorted(ls, key=lambda e: number[e["label"]]))] for s, ls in zip(pdf["size"], pdf["labels"], strict=True)]
        begins = np.concatenate([[0], np.cumsum([len(o) for o in own])])
        used, columns = np.unique([c for o in own for c, _ in o], return_inverse=True)
        amounts, start = np.array([n for o in own for _, n in o]), pdf["at"].to_numpy(np.int64)
        goal = missing[:, used].copy()
        np.add.at(goal, (np.repeat(start, np.diff(begins)), columns), amounts)
        block, replica = int(pdf["block"].iloc[0]), int(pdf["replica"].iloc[0])
        at, cost = anneal(begins, columns, amounts, start, goal, hash((seed, turn, replica, block)) & 0x7FFFFFFF, steps)
        return pd.DataFrame({"block": pdf["block"], "replica": replica, "cost": cost, "component": pdf["component"], "new_at": at.astype(np.int32)})

    return search


def search_splits(placed: DataFrame, targets: DataFrame, seed: int = 7, replicas: int = 4, rounds: int = 2, steps: int = 6000) -> DataFrame:
    """``component, new_split, n``: a split for each component, shares near the targets.

    The start is a hashed assignment. Components are hashed into blocks of about BLOCK; each block is annealed by
    several replicas at once, the best is kept, and the next round sees what the whole still lacks. Deviation counts
    records and, at half weight, records of each label (domain), all exactly. Targets with null or no positive share
    are left out.
    """
    spark = placed.sparkSession
    goals = [(r[0], r[1]) for r in targets.where("split is not null and target_share > 0").groupBy("split").agg(F.max("target_share")).orderBy("split").limit(1001).collect()]
    if not goals or len(goals) > 1000:
        raise ValueError("between 1 and 1000 splits with a positive share are needed")
    names = [g[0] for g in goals]
    shares = np.array([g[1] for g in goals]) / sum(g[1] for g in goals)
    cells = materialise(placed.groupBy("component", F.col("domain_key").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    labels = {r["label"]: 1 + i for i, r in enumerate(cells.select("label").distinct().orderBy("label").limit(MAX_CELLS // len(names) + 1).collect())}
    if len(labels) * len(names) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} splits and labels")
    comps = materialise(cells.groupBy("component").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("labels")))
    n_blocks = max(1, -(-comps.count() // BLOCK))
    edges = np.cumsum(shares)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = F.array_position(F.array(*[u < F.lit(float(e)) for e in edges[:-1]], F.lit(True)), True) - 1
    state = comps.withColumn("at", first.cast("int")).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(n_blocks)).cast("int"))

    old: list[DataFrame] = []
    for turn in range(rounds):
        state = materialise(state)
        discard(*old)
        have = np.zeros((len(names), 1 + len(labels)))
        for r in state.select("at", F.inline("labels")).groupBy("at", "label").agg(F.sum("n").alias("n")).collect():
            have[r["at"], labels[r["label"]]] += r["n"] / 2
            have[r["at"], 0] += r["n"]
        lack = spark.sparkContext.broadcast((labels, (shares[:, None] * have.sum(axis=0) - have) / n_blocks))

        many = state.withColumn("replica", F.explode(F.array(*map(F.lit, range(replicas)))))
        tried = materialise(many.groupBy("block", "replica").applyInPandas(_block_search(lack, seed, turn, steps), "block int, replica int, cost double, component string, new_at int"))
        old = [state, tried]
        best = tried.groupBy("block").agg(F.min(F.struct("cost", "replica")).alias("b")).select("block", F.col("b.replica").alias("replica"))
        state = state.join(tried.join(best, ["block", "replica"]).select("component", "new_at"), "component").withColumn("at", F.col("new_at")).drop("new_at")
    return state.select("component", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("new_split"), F.col("size").alias("n"))


def assign_splits(records: DataFrame, id_col: str, catalog: DataFrame, targets: DataFrame, seed: int = 7, **search: int) -> DataFrame:
    """``id``, ``component``, ``new_split``: all records of related sources in one split, shares near the targets.

    See place_records and search_splits. Repeated rows of an id stay; an empty table gives no rows.
    """
    placed = materialise(place_records(records, id_col, catalog))
    found = materialise(search_splits(placed, targets, seed, **search))
    return join_by_counts(placed.select("id", "component"), found, ["component"], "n", placed.count()).select("id", "component", "new_split")


def broken_groups(records: DataFrame, id_col: str, catalog: DataFrame, targets: DataFrame, split_col: str = "split", seed: int = 7, **search: int) -> DataFrame:
    """``group_id, source_id, new_split, n_records, n_moved``: the groups that the present split breaks, as the new one shows.

    Each group now has one split, so a group was broken if the records that came together there had more than one
    split before. One row for each source with records; n_records and n_moved (records whose split changes) are those
    of the whole group. Records with a null split are in no split.
    """
    placed = materialise(place_records(records, id_col, catalog, split_col))
    found = search_splits(placed, targets, seed, **search)
    counted = placed.where("group_id is not null").groupBy("component", "group_id", "source_id", "split").agg(F.count(F.lit(1)).alias("m"))
    moved = materialise(counted.join(found.drop("n"), "component"))
    per = moved.groupBy("group_id", "new_split").agg(
        F.sum("m").alias("n_records"), F.sum(F.when(F.col("split") != F.col("new_split"), F.col("m")).otherwise(0)).alias("n_moved"), F.min("split").alias("_lo"), F.max("split").alias("_hi")
    )
    broken = per.where("_lo <> _hi and n_moved > 0").drop("_lo", "_hi")
    return moved.select("group_id", "source_id").distinct().join(broken, "group_id").select("group_id", "source_id", "new_split", "n_records", "n_moved")


def split_checks(records: DataFrame, id_col: str, catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: ``n_records, n_ids``, and how many groups of related sources stand in more than one new split."""
    done = assign_splits(records, id_col, catalog, targets)
    per = materialise(done).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("m"), F.countDistinct("new_split").alias("s"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_ids"), F.count_if(F.col("s") > 1).alias("n_divided"))
