"""The operators on records against brute force, and their edge cases."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm.fm_index import FMIndex, suffix_order
from bitloom.llm import codepoints, format_dedup
from bitloom.llm.format_dedup import collapse_formats, format_duplicates
from bitloom.llm.group_split import anneal, assign_splits, broken_groups, source_groups
from bitloom.llm.quota_sample import quota_sample, sample_sizes, swap_repair
from bitloom.llm.split_overlap import Shard, breakable, overlap_pairs, overlap_report, split_overlap

RECORD = "pair_id bigint, hun string, eng string, split string, source_file string, domain string, id string, rep string, n bigint, k1 string, set_key string, a string"
VOCABULARY = ["alma", "körte", "Ház", "víz", "the", "and", "tree", "water", "12", "ő"]


def fold(t):
    return "".join(c.lower() for c in t or "" if unicodedata.category(c)[0] in "LN")


def word_set(*texts):
    return {w for t in texts for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (t or "")).lower().split()}


def letter(t):
    return any(unicodedata.category(c)[0] == "L" for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 12))) for _ in range(60)]
    odd = [None, "", "   ", "!?", "½", "12", "x" * 50_000, "ÁÉ-ő", "á é ő", "12 a"]
    for i in range(500):
        h, e = rng.choice(texts), rng.choice(texts[:8])
        if rng.random() < 0.3:
            h, e = e, h
        if rng.random() < 0.3:
            h = h.upper() + " ."
        if rng.random() < 0.3:
            e = e.replace(" ", "  - ")
        if rng.random() < 0.1:
            h = rng.choice(odd)
        if rng.random() < 0.1:
            e = rng.choice(odd)
        if rng.random() < 0.3:  # a hot group
            h, e = "Ugyanaz a mondat.", "the same sentence"
        out.append((i * 3, h, e, rng.choice(["train", "train", "valid", "test", None]), "f", "d", "clash", "clash", 5, "clash", "clash", "clash"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD).repartition(5)


def expected_twins(rows):
    groups = defaultdict(list)
    for r in rows:
        if letter(r[1]) and letter(r[2]):
            groups[tuple(sorted((fold(r[1]), fold(r[2]))))].append(r[0])
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_format_duplicates(spark, rows):
    got = [(r.rep, r.id) for r in format_duplicates(frame(spark, rows), "pair_id", "hun", "eng").collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected_twins(rows)
    again = format_duplicates(frame(spark, rows + rows[:50]), "pair_id", "hun", "eng")
    assert {(r.rep, r.id) for r in again.collect()} == expected_twins(rows)


def test_colliding_hashes_are_told_apart(spark, rows, monkeypatch):
    real = format_dedup.folded_hashes

    def coarse(texts):
        h, has = real(texts)
        return h % 3, has

    keyed = format_dedup._hash_batches

    def colliding(batches):
        import pyarrow as pa

        for b in keyed(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy() % 3), pa.array(b.column(2).to_numpy() % 2)], ["id", "k1", "k2"])

    monkeypatch.setattr(format_dedup, "_hash_batches", colliding)
    small = rows[:120]
    got = {(r.rep, r.id) for r in format_dedup.format_duplicates(frame(spark, small), "pair_id", "hun", "eng").collect()}
    assert got == expected_twins(small)
    assert coarse(["a"])[1].tolist() == [True]


def test_hashes_and_pointers_skip_alike():
    rng = random.Random(8)
    texts = ["".join(rng.choices("aAáÁ .,-1İσΣς\n", k=rng.randint(0, 7))) for _ in range(3000)] + [None]
    others = ["".join(rng.choice([c.upper(), c]) + rng.choice(["", " ", ". "]) for c in t or "") if rng.random() < 0.7 else rng.choice(texts) for t in texts]
    plain = lambda t: "".join(c.lower()[0] for c in t or "" if c.isalnum())
    want = [plain(a) == plain(b) for a, b in zip(texts, others, strict=True)]
    assert codepoints.equal_folded(texts, others).tolist() == want
    hashes, letters = codepoints.folded_hashes(texts + others)
    assert (hashes[: len(texts)] == hashes[len(texts) :]).tolist() == want
    assert letters.tolist() == [letter(t) for t in texts + others]


def test_collapse(spark, rows):
    got = {r.pair_id: r.n_copies for r in collapse_formats(frame(spark, rows), "pair_id", "hun", "eng").collect()}
    sizes = Counter(a for a, _ in expected_twins(rows))
    gone = {b for _, b in expected_twins(rows)}
    assert got == {r[0]: sizes.get(r[0], 0) + 1 for r in rows if r[0] not in gone}
    assert collapse_formats(frame(spark, rows[:0]), "pair_id", "hun", "eng").count() == 0


def expected_overlap(rows, share=0.8):
    sets = [(r[0], r[3], word_set(r[1], r[2])) for r in rows if letter(r[1]) and letter(r[2]) and r[3] is not None]
    out = set()
    for i, si, a in sets:
        for j, sj, b in sets:
            if si == "train" and sj != "train" and 1_000_000 * len(a & b) >= round(1_000_000 * share) * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("share", [0.8, 0.9, 0.6])
def test_split_overlap(spark, rows, share):
    pairs = overlap_pairs(frame(spark, rows), "pair_id", "hun", "eng", "split", share)
    got = [(r.pair_id_a, r.pair_id_b) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected_overlap(rows, share)


def test_split_overlap_in_several_shards(spark, rows, monkeypatch):
    from bitloom.llm import split_overlap as module

    monkeypatch.setattr(module, "SHARD", 20)
    monkeypatch.setattr(module, "STEP", 50)
    for share in (0.8, 0.6):
        found = [(r.pair_id_a, r.pair_id_b) for r in overlap_pairs(frame(spark, rows), "pair_id", "hun", "eng", "split", share).collect()]
        assert len(found) == len(set(found))
        assert set(found) == expected_overlap(rows, share)


@pytest.mark.parametrize("shard", [20, 150_000])
def test_split_overlap_filtered(spark, rows, monkeypatch, shard):
    from bitloom.llm import split_overlap as module

    for name, value in (("FILTERED", 5), ("PART", 100), ("NEAR_STEP", 30), ("SHARD", shard)):
        monkeypatch.setattr(module, name, value)
    found = [(r.pair_id_a, r.pair_id_b) for r in overlap_pairs(frame(spark, rows), "pair_id", "hun", "eng", "split").collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected_overlap(rows)


def test_sets_without_a_match_are_not_searched(spark, monkeypatch):
    from bitloom.llm import split_overlap as module

    rng = random.Random(12)
    texts = [[f"w{rng.randrange(150)}" for _ in range(20)] for _ in range(600)]
    table = [(i, " ".join(w[:10]), " ".join(w[10:]), "train" if i % 3 else "test") for i, w in enumerate(texts)]
    table += [(1000 + i, " ".join(texts[i][:10]), " ".join([*texts[i][10:], "new"]), "train") for i in range(0, 60, 3)]
    seen, possible = [], module.possible

    def spy(*args):
        out = possible(*args)
        seen.extend((df.count() for df in (*args[:2], *out)))
        return out

    monkeypatch.setattr(module, "possible", spy)
    monkeypatch.setattr(module, "FILTERED", 5)
    df = spark.createDataFrame(table, "pair_id bigint, hun string, eng string, split string")
    found = {(r.pair_id_a, r.pair_id_b) for r in overlap_pairs(df, "pair_id", "hun", "eng", "split").collect()}
    assert found == expected_overlap(table) and len(found) >= 20
    assert seen[:2] == [420, 200]
    assert all(20 <= n < 60 for n in seen[2:])


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_near_sets_keep_every_match(share):
    from bitloom.llm import split_overlap as module

    rng = random.Random(13)
    number = lambda w: (1 + w % 60) << module.HASH_BITS | w * 7919
    held = [sorted(map(number, rng.sample(range(1, 200), rng.randint(1, 40)))) for _ in range(150)] + [sorted(map(number, range(1, 5001)))]
    asked = [sorted({*rng.sample(h, max(1, len(h) - rng.randint(0, len(h) // 5))), *map(number, rng.sample(range(1, 200), rng.randint(0, len(h) // 8)))}) for h in held]
    asked += [sorted(map(number, rng.sample(range(1, 200), 30))) for _ in range(300)]
    sides = []
    for sets, most in ((asked, True), (held, False)):
        values, counts = np.array([w for s in sets for w in s], dtype=np.int64), np.array([len(s) for s in sets])
        levels = np.zeros(1 << module.LEVEL_BITS, dtype=np.uint8)
        sides.append(module.filter_pairs(values, counts, np.arange(len(sets), dtype=np.int32), *((levels, breakable(counts, share) + 1) if most else ())))
    got = set(map(tuple, module.near_sets(sides[0], np.sort(sides[1], order="key"), share).tolist()))
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(held) if len({*a} & {*b}) >= share * len({*a} | {*b}) - 1e-9}
    assert want <= got and len(got) < len(want) + 300


def test_maximal_matches_and_merged_spans():
    rng = random.Random(9)
    held = [sorted(rng.sample(range(1, 60), rng.randint(1, 25))) for _ in range(80)]
    asked = [sorted({*rng.sample(h, max(1, len(h) - rng.randint(0, 3))), *rng.sample(range(1, 60), rng.randint(0, 2))}) for h in held]
    shard = Shard.loads(Shard.build([np.array(h, dtype=np.int64).tobytes() for h in held], [bytes(16)] * 80).dumps())
    assert [s.tolist() for s in np.split(shard.index.symbols[shard.sets - 1], shard.begins[1:-1])] == held
    counts = np.array([len(a) for a in asked])
    found = set()
    for t, e, common, spans, inside in shard.search(np.array([w for a in asked for w in a], dtype=np.int64), counts, 0.8):
        for i, j, c, n, w in zip(*(x.tolist() for x in (t, e, common, spans, inside)), strict=True):
            a, b = asked[i], held[j]
            found.add((i, j))
            assert c == len({*a} & {*b})
            runs, at = [], 0
            while at < len(a):  # the maximal runs of the one that stand in the other
                k = 0
                while at + k < len(a) and a[at] in b and b[b.index(a[at]) :][: k + 1] == a[at : at + k + 1]:
                    k += 1
                runs += [k] * (k > 1 or (k == 1 and len(a) == len(b) == 1))
                at += max(k, 1)
            assert n <= len(runs) and w <= sum(runs) and (n < len(runs) or w == sum(runs))
    assert found == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(held) if 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})}


def test_copies_are_one_set(spark, rows):
    matches, members = split_overlap(frame(spark, rows), "pair_id", "hun", "eng", "split")
    assert members.select("set_key").distinct().count() < members.count()
    assert matches.groupBy("train_id", "set_key").count().where("count > 1").isEmpty()


def test_overlap_report_and_empty(spark, rows):
    report = overlap_report(frame(spark, rows), "pair_id", "hun", "eng", "split", "source_file")
    assert report.agg(F.sum("n_pairs")).first()[0] == len(expected_overlap(rows))
    assert overlap_pairs(frame(spark, rows[:0]), "pair_id", "hun", "eng", "split").count() == 0
    only = [r for r in rows if r[3] == "train"]
    assert overlap_pairs(frame(spark, only), "pair_id", "hun", "eng", "split").count() == 0


def test_breakable_pairs_bound():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randint(1, 40)
        a = sorted(rng.sample(range(200), n))
        b = sorted({*rng.sample(a, max(1, n - rng.randint(0, 8))), *rng.sample(range(200), rng.randint(0, 8))})
        if 5 * len({*a} & {*b}) < 4 * len({*a} | {*b}):
            continue
        lost = set(zip(a, a[1:], strict=False)) - set(zip(b, b[1:], strict=False))
        assert len(lost) <= breakable(np.array([n]), 0.8)[0]


def test_fm_index_against_scanning():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 40)
    values = rng.integers(0, 5, counts.sum())
    index = FMIndex.build(values, counts)
    parts = np.split(values, np.cumsum(counts)[:-1])
    for a in range(6):
        for b in range(6):
            codes = index.encode(np.array([a, b]))
            low, high = index.start(codes[1:])
            low, high = index.extend(codes[:1], low, high)
            found = sorted(index.owner[index.suffixes[low[0] : high[0]]].tolist())
            assert found == sorted(i for i, p in enumerate(parts) for x, y in zip(p, p[1:], strict=False) if (x, y) == (a, b))
    text = rng.integers(0, 3, 100)
    assert suffix_order(text).tolist() == sorted(range(100), key=lambda i: text[i:].tolist())


PLANS = "plan_id string, domain string, target_share double, min_rows bigint, sample_share double"


def test_quotas(spark):
    data = [(i, d) for i, d in enumerate(["Law "] * 600 + ["law"] * 60 + ["web"] * 9 + ["lit"] * 330 + [None] * 40)]
    records = spark.createDataFrame(data, "pair_id bigint, domain string").withColumn("_key", F.lit(1))
    targets = spark.createDataFrame(
        [("p", "law", 0.5, 10, 0.4), ("p", "web", 0.1, 5, 0.4), ("p", "lit", 0.4, 5, 0.4), ("q", "web", 0.0, 9, 0.1), ("q", "news", 0.0, 0, 0.1), ("q", "law", 1.0, None, 0.1), ("q", "law", 1.0, None, 0.1), (None, "law", 1.0, 1, 1.0), ("z", "web", 0.5, 8, 0.01), ("z", "law", 0.5, 9, 0.01)], PLANS
    )
    sample, report = quota_sample(records, "pair_id", "domain", targets)
    report = {(r.plan_id, r.domain): r for r in report.collect()}
    assert {k for k, r in report.items() if r.short} == {("p", "web")}
    assert {k for k, r in report.items() if not r.met} == {("p", "web"), ("q", "law")}  # the floor of web takes from law
    assert report["p", "web"].taken == 9
    assert report["q", "web"].taken == 9
    assert (report["z", "web"].taken, report["z", "law"].taken) == (8, 9)
    assert sum(r.taken for (p, _), r in report.items() if p == "p") == pytest.approx(0.4 * 999, abs=1)
    rows = sample.collect()
    taken = Counter((r.plan_id, r.category) for r in rows)
    assert all(taken.get(k, 0) == r.taken for k, r in report.items())
    assert len({(r.plan_id, r.pair_id) for r in rows}) == len(rows)
    assert {r.plan_id: (r.n_rows == r.n_ids, r.floors_kept) for r in sample_sizes(records, "pair_id", "domain", targets).collect()} == dict.fromkeys("pqz", (True, True))
    assert quota_sample(records.limit(0), "pair_id", "domain", targets)[1].where("short").count() == 6
    assert quota_sample(records, "pair_id", "domain", targets.limit(0))[0].count() == 0


def test_the_start_of_the_sample_is_kept(spark):
    """Without floors and with targets that are the present shares, the sample is the random start but for its size."""
    records = spark.range(4000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("domain"))
    targets = spark.createDataFrame([("p", "a", 0.5, 0, 0.1), ("p", "b", 0.5, 0, 0.1)], PLANS)
    got = {r.pair_id for r in quota_sample(records, "pair_id", "domain", targets)[0].collect()}
    start = records.where(F.shiftrightunsigned(F.xxhash64(F.lit(7), F.lit("p"), F.col("pair_id")), 11) / float(1 << 53) < 0.1)
    assert len(got) == 400
    assert len(got & {r.pair_id for r in start.collect()}) > 350


def test_swap_repair_reaches_the_targets():
    rng = random.Random(4)
    for _ in range(200):
        names = [f"c{i}" for i in range(rng.randint(1, 6))]
        available = {c: rng.randint(0, 300) for c in names}
        shares = [rng.random() for _ in names]
        size = rng.randint(0, 300)
        wanted = {c: s / sum(shares) * size for c, s in zip(names, shares, strict=True)}
        floors = {c: rng.choice([0, 0, 5, 30]) for c in names}
        start = {c: rng.randint(0, 300) for c in names}
        take = swap_repair(available, floors, wanted, size, start)
        least = {c: min(floors[c], available[c]) for c in names}
        assert all(least[c] <= take[c] <= available[c] for c in names)
        assert sum(take.values()) == max(sum(least.values()), min(size, sum(available.values())))
        if all(available[c] >= wanted[c] + 1 and floors[c] <= wanted[c] for c in names):
            assert all(abs(take[c] - wanted[c]) <= 1 for c in names)


CATALOG = "source_id bigint, source_file string, domain string, author string, series string"


def components(catalog):
    parent = {r[0]: r[0] for r in catalog}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for r in catalog:
        for k, v in (("a", r[3]), ("s", r[4])):
            name = (v or "").strip().lower()
            if name in ("", "unknown", "n/a", "-", "ismeretlen", "various"):
                continue
            a, b = root(r[0]), root(seen.setdefault((k, name), r[0]))
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.fixture(scope="module")
def catalog():
    rng = random.Random(6)
    people = [None, "", "Unknown", " - ", "Various", *(f"Author {i}" for i in range(25))]
    out = []
    for i in range(80):
        out.append((i * 2, f"file{i}.bi", rng.choice(["law", "web"]), rng.choice(people), rng.choice([None, "n/a", *(f"Series {j}" for j in range(40))])))
    out += [(s, f, d, (a or "").upper() or None, None) for s, f, d, a, _ in out[:10]]  # repeated rows, other case
    out += [(1000 + i, f"chain{i}.bi", "web", f"chain {i // 2}", f"link {(i + 1) // 2}") for i in range(60)]  # a long chain
    return out


def test_source_groups(spark, catalog):
    got = {r.source_id: r.group_id for r in source_groups(spark.createDataFrame(catalog, CATALOG)).collect()}
    assert got == components(catalog)
    assert source_groups(spark.createDataFrame([], CATALOG)).count() == 0


def split_records(catalog):
    rng = random.Random(7)
    out = []
    for i in range(2000):
        s = catalog[0] if rng.random() < 0.3 else rng.choice(catalog[:80])
        name = rng.choice([s[1], s[1].upper(), f"./x/{s[1]} ", f"a\\{s[1]}", None if rng.random() < 0.1 else s[1]])
        out.append((i, name, rng.choice([s[2], s[2].upper(), f" {s[2]}"]), rng.choices(["train", "valid", "test"], [30, 1, 1])[0]))
    return out


def TARGETS(spark):  # noqa: N802
    return spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), (None, 0.3), ("none", None)], "split string, target_share double")


def test_broken_groups(spark, catalog):
    records = split_records(catalog)
    group = components(catalog)
    key = {(r[2], r[1]): r[0] for r in catalog}
    splits, used = defaultdict(set), defaultdict(set)
    for _, f, d, s in records:
        source = key.get((d.strip().lower(), f.strip().lower().replace("\\", "/").split("/")[-1])) if f else None
        if source is not None:
            splits[group[source]].add(s)
            used[group[source]].add(source)
    want = {(g, s) for g in used if len(splits[g]) > 1 for s in used[g]}
    frame = spark.createDataFrame(records, "pair_id bigint, source_file string, domain string, split string")
    sources = spark.createDataFrame(catalog, CATALOG)
    found = broken_groups(frame, "pair_id", sources, TARGETS(spark), steps=500).collect()
    got = [(r.group_id, r.source_id) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert all(0 < r.n_moved <= r.n_records for r in found)
    assert broken_groups(frame.limit(0), "pair_id", sources, TARGETS(spark)).count() == 0
    assert broken_groups(frame, "pair_id", sources.limit(0), TARGETS(spark)).count() == 0


def test_new_splits_keep_groups_together(spark):
    catalog = [(i, f"file{i}.bi", "law" if i % 3 else "web", f"Author {i // 2}", None) for i in range(80)]
    records = split_records(catalog)
    frame = spark.createDataFrame(records, "pair_id bigint, source_file string, domain string, split string").withColumn("component", F.lit("clash"))
    targets = TARGETS(spark)
    got = assign_splits(frame, "pair_id", spark.createDataFrame(catalog, CATALOG), targets).collect()
    assert len(got) == len(records)
    assert len({r.id for r in got}) == len(records)
    by = defaultdict(set)
    for r in got:
        by[r.component].add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r.new_split for r in got)
    assert share["train"] / len(got) == pytest.approx(0.8, abs=0.03)
    assert set(share) <= {"train", "valid", "test"}
    assert assign_splits(frame.limit(0), "pair_id", spark.createDataFrame(catalog, CATALOG), targets).count() == 0
    with pytest.raises(ValueError, match="positive share"):
        assign_splits(frame, "pair_id", spark.createDataFrame(catalog, CATALOG), targets.limit(0))


def test_annealing_never_ends_worse():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 60).astype(float)
    label = rng.integers(1, 4, 60)
    columns = np.stack([np.zeros(60, dtype=np.int64), label], axis=1).ravel()
    amounts = np.stack([size, size / 2], axis=1).ravel()
    start = rng.integers(0, 3, 60)
    whole = np.bincount(columns, weights=amounts, minlength=4)
    targets = np.array([0.8, 0.1, 0.1])[:, None] * whole

    def deviation(at):
        have = np.zeros_like(targets)
        np.add.at(have, (np.repeat(at, 2), columns), amounts)
        return np.abs(have - targets).sum()

    at, cost = anneal(np.arange(0, 121, 2), columns, amounts, start, targets, 1, 6000)
    assert cost == pytest.approx(deviation(at))
    assert cost < 0.1 * deviation(start)
    assert np.abs(np.bincount(at, weights=size, minlength=3) - targets[:, 0]).max() < 15
