"""Sources, sinks and smaller operators."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.operators import augment as A
from bitloom.operators import filters as L
from bitloom.operators import joins as J
from bitloom.operators import near_duplicates as N
from bitloom.operators import reports as P
from bitloom.operators import sampling as M
from bitloom.operators import scoring as S
from bitloom.operators import stats as D
from bitloom.plans import reference_queries as Q
from bitloom.sources import lines as I
from bitloom.sources import sinks as O
from bitloom.sources import tables as B


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_aligned_files_stop_with_the_shorter(spark, tmp_path):
    a, b = write(tmp_path / "a", " egy \nkettő\nhárom\n"), write(tmp_path / "b", "one\n\n")
    rows = I.read_aligned(spark, a, b).orderBy("pair_id").collect()
    assert [(r.pair_id, r.src, r.tgt) for r in rows] == [(0, "egy", "one"), (1, "kettő", "")]
    assert I.read_aligned_batches(spark, a, b, 1, skip=1).count() == 1
    assert [r.value for r in I.read_combined(spark, a, b).orderBy("pair_id").collect()] == ["egy\tone", "kettő\t"]


def test_lines_of_many_splits(spark, tmp_path):
    files = {"10": [f"b{i}" for i in range(3000)], "9": [f"a{i}" for i in range(2000)]}
    for name, rows in files.items():
        write(tmp_path / "many" / name, "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r.value for r in I.read_lines(spark, f"{tmp_path}/many").orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == files["9"] + files["10"]


def test_natural_order(spark):
    names = spark.createDataFrame([("10.tsv",), ("2.tsv",), ("b1a20",), ("b1a3",)], "n string")
    assert [r.n for r in names.orderBy(I.natural_key(F.col("n"))).collect()] == ["2.tsv", "10.tsv", "b1a3", "b1a20"]


def test_tsv_bitext(spark, tmp_path):
    write(tmp_path / "corpus/law/bi/x.bi", "ő\tone\nbad line\na\tb\tc\n\nű \ttwo\n", "iso8859-2")
    write(tmp_path / "corpus/web/y.bi", "é\tthree\n", "iso8859-2")
    rows, bad = I.read_tsv_bitext(spark, f"{tmp_path}/corpus")
    assert {tuple(r) for r in rows.collect()} == {("ő", "one", "x.bi", "law"), ("ű ", "two", "x.bi", "law"), ("é", "three", "y.bi", "web")}
    assert bad.count() == 2
    assert "ű" in {r.hun for r in I.read_tsv_bitext(spark, f"{tmp_path}/corpus", trim=True)[0].collect()}


def test_nested_records_and_listing(spark, tmp_path):
    p = write(tmp_path / "d/t.json", json.dumps({"id": "1", "translation": {"en": "a", "hu": "b"}}) + "\n")
    assert [tuple(r) for r in I.read_translations(spark, p, "c").collect()] == [("c", "a", "b")]
    assert [r.name for r in I.list_files(spark, f"{tmp_path}/d").collect()] == ["t.json"]


def test_config_history_and_scores(spark, tmp_path):
    p = write(tmp_path / "c.yaml", "preprocessor:\n  source_language: hu\n  target_language: en\n  total_wordcount_max: 16\npaths:\n  a: ../x\n  b: [./y, z]\n")
    config = B.read_config(p)
    assert B.PreprocessConfig.of({"preprocessor": config["preprocessor"]}).total_wordcount_max == 16
    with pytest.raises(ValueError, match="unknown keys"):
        B.PreprocessConfig.of({"nothing": 1})
    assert B.flatten(config)["preprocessor.source_language"] == "hu"
    assert B.parent_paths(config)["paths"] == {"a": "../../x", "b": [".././y", "z"]}
    assert B.read_score(write(tmp_path / "r.json", '{"score": 34.5, "name": "x"}')) == {"score": 34.5}
    assert B.read_score(write(tmp_path / "r.txt", "BLEU+case.mixed = 33.5 64.1/40.9")) == {"score": 33.5}
    one = B.append_history(spark, None, {"a": {"b": 1}}, {"score": 1.0}, "d", "p", "g")
    two = B.append_history(spark, one, {"a": {"c": 2}}, {"score": 2.0}, "d", "p", "g")
    assert {(r["a.b"], r["a.c"]) for r in two.select("`a.b`", "`a.c`").collect()} == {("1", None), (None, "2")}
    status = spark.createDataFrame([("r", "in_progress", None)], "run string, state string, result string")
    assert [tuple(r) for r in B.upsert_status(status, "r", "done", "1").collect()] == [("r", "done", "1")]
    assert B.steps_per_epoch(1000, 20.5, 4096) == 5
    assert B.mixing_weights(2) == (1, 2) and B.mixing_weights(0.5) == (2, 1)
    assert len(B.experiment_grid({"ratio": [0.5, 0], "method": ["ged", "base", "edge_mapper"]}, 3)) == 18


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(2, "c", None), (0, "a", "x"), (1, "b", "y")], "pair_id bigint, src string, tgt string")
    O.write_pairs(pairs, f"{tmp_path}/p")
    read = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert (read("p/src"), read("p/tgt")) == ("a\nb\nc\n", "x\ny\n\n")
    made = spark.createDataFrame([("m", 0, 0, "a", "x"), ("m", 0, 1, "b", "y")], "method string, draw bigint, slot int, src string, tgt string")
    O.write_augmented(made, f"{tmp_path}/t")
    assert sorted(read("t/method=m").splitlines()) == ["a\tx", "b\ty"]
    O.write_augmented(made, f"{tmp_path}/b", "basic")
    assert read("b/tgt/method=m") == "x\ny\n"
    with pytest.raises(ValueError, match="layout"):
        O.write_augmented(made, "x", "y")
    split = spark.createDataFrame([("train", "a", "b", "law")], "new_split string, hun string, eng string, domain string")
    O.write_splits(split, f"{tmp_path}/s")
    O.write_domains(split, f"{tmp_path}/d")
    assert read("s/new_split=train") == read("d/domain=law") == "a\tb\n"


def test_length_rules(spark):
    n = spark.createDataFrame([(-1, 8, 14), (81, 50, 57), (45, 8, 16), (3, 0, 5)], "n int, a int, b int")
    got = n.select(L.in_band(F.col("n"), 0, 80).alias("band"), L.compatible(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.band for r in got] == [False, False, True, True]
    assert [r.c for r in got] == [True, True, False, True]


def test_batches_and_mini_batches(spark):
    rows = spark.range(5)
    sizes = lambda k: {r.mini_batch: r["count"] for r in M.mini_batches(rows, "id", k, 5).groupBy("mini_batch").count().collect()}
    assert sizes(3) == {0: 2, 1: 2, 2: 1}
    assert sizes(7) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1}
    assert [r.batch for r in M.batches(rows, "id", 2, 1).orderBy("id").collect()] == [1, 1, 2]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(200).withColumn("g", F.col("id") % 3)
    a = sorted(r.id for r in M.sample_per_group(rows.repartition(9), ["g"], "id", 5, 1).collect())
    assert a == sorted(r.id for r in M.sample_per_group(rows.coalesce(1), ["g"], "id", 5, 1).collect())
    assert len(a) == 15
    split = M.split_by_group(rows, "g", "id", 4, 6, 1).groupBy("g", "new_split").count().collect()
    assert {(r.g, r.new_split): r["count"] for r in split if r.new_split != "train"} == {(g, s): n for g in range(3) for s, n in (("test", 4), ("valid", 6))}
    drawn = M.sample_with_replacement(spark.range(4000), "id", 0.5, 3)
    assert drawn.count() == pytest.approx(2000, rel=0.1)
    assert drawn.where("copy > 1").count() > 100


def test_sampled_combinations(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None, "g") for i in range(90)], "pair_id bigint, a bigint, b string")
    group = {i: i % 3 for i in range(90) if i % 7}
    every = {(i, j) for i in group for j in group if i < j and group[i] == group[j]}
    for k in (0, 5, 60, 700, 10_000):
        got = [(r.pair_a, r.pair_b) for r in J.sampled_combinations(rows.repartition(3), ["a", "b"], "pair_id", k, 3).collect()]
        assert len(got) == len(set(got)) == min(k, len(every))
        assert set(got) <= every
    assert J.sampled_combinations(rows.limit(0), ["a", "b"], "pair_id", 5, 3).count() == 0
    links = {r.id: (r.class_id, r.n_links) for r in J.links_within(rows, ["a", "b"], "pair_id").collect()}
    assert links == {i: (min(j for j in group if group[j] == g), sum(x == g for x in group.values()) - 1) for i, g in group.items()}


def test_sampled_combinations_of_one_group(spark):
    # a large part of all pairs is wanted, and single rows need more than 200 partners
    rows = spark.range(1000).select(F.col("id").alias("pair_id"), F.lit(1).alias("a"))
    for k in (10_000, 200_000):
        got = J.sampled_combinations(rows, ["a"], "pair_id", k, 3).collect()
        assert len({(r.pair_a, r.pair_b) for r in got}) == len(got) == k
        degree = Counter(x for r in got for x in (r.pair_a, r.pair_b))
        assert max(degree.values()) < 1.6 * min(degree.values()) if k > 10_000 else min(degree.values()) > 0


def test_same_lemma_pairs_grow_with_the_table(spark, sf):
    pairs = Q._pairs(spark, sf)
    k, links = A.target_pairs(pairs.count(), 0.5), sum(r.n_links for r in Q.same_lemma_links(spark, sf).collect()) // 2
    got = {(r.pair_a, r.pair_b) for r in Q.swap_same_lemma(spark, sf).collect()}
    assert len(got) == min(k, links)


def test_numbered_places(spark):
    grouped = J.numbered(spark.range(300).withColumn("g", F.col("id") % 4), "id", 1, "g").collect()
    assert sorted((r.g, r.pos) for r in grouped) == [(g, p) for g in range(4) for p in range(75)]

    at = J.numbered(spark.range(500).repartition(7), "id", 1)
    assert sorted(r.pos for r in at.collect()) == list(range(500))


def test_outer_counts_and_overlap(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "label string, a bigint")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "label string, b bigint")
    assert {tuple(r) for r in J.outer_counts(a, b, "label").collect()} == {("x", 1, 0), ("y", 2, 3), ("z", 0, 4)}
    assert J.overlap(a, b, ["label"]).count() == 1
    assert J.without_overlap(a, b, ["label"]).count() == 1


def test_bleu(spark):
    assert S.bleu_of(S.bleu_statistics("the cat sat on the mat .", "the cat sat on the mat .")) == pytest.approx(100)
    assert S.bleu_of(S.bleu_statistics("a b", "c d")) == 0
    assert S.tokenise_13a("Hello, world! 3.5-4 (a)") == ["Hello", ",", "world", "!", "3.5", "-", "4", "(", "a", ")"]
    short = S.bleu_of(S.bleu_statistics("the cat", "the cat sat"), True)
    assert 0 < short < 100
    rows = spark.createDataFrame([("the cat sat on it .", "the cat sat on it ."), (None, "x")], "h string, r string")
    assert S.corpus_bleu(rows, "h", "r").first().bleu == pytest.approx(100)
    assert S.corpus_bleu(rows.limit(0), "h", "r").first().bleu == 0
    assert [r.b is None for r in rows.select(S.sentence_bleu(F.col("h"), F.col("r")).alias("b")).collect()] == [False, True]


def test_filters_by_score(spark):
    rows = spark.createDataFrame([("m", f"a b c {i}", "a b c 1") for i in range(4)], "method string, src string, tgt string")
    same = lambda c: c
    assert S.FILTERS["bleu"](same, same, 0.5)(rows).count() == 1
    scored = S.QuantileFilter(F.length("src").cast("double"), F.length("tgt").cast("double"), 0.0)
    assert scored(rows).count() == 0  # strictly above the lowest
    vec = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    assert S.CosineFilter(same, same, vec, vec, 0.0)(rows).count() == 0


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in rows.select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.7071, abs=1e-4)
    assert got[1] is None


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    r = D.describe(rows, ["x"]).first()
    assert (r.n, r.mean, r.std_sample, r.q500) == (3, 2.0, 1.0, 2.0)
    assert {x.bin: x.n for x in D.equal_width_bins(rows, "x", 2).collect()} == {1: 2, 2: 1}
    assert D.equal_width_bins(rows.limit(0), "x", 2).count() == 0
    assert D.ngram_counts(spark.createDataFrame([("A b a b",), ("",), (None,)], "t string"), "t", 2).where("ngram = 'a b'").first().cnt == 2


def test_predictions(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no bigint, value string")
    b = spark.createDataFrame([(3, "d"), (0, "a"), (1, "b"), (2, "c")], "line_no bigint, value string")
    assert {r.original: r.predictions for r in P.pair_predictions(a, b, 2).collect()} == {"x": ["a", "b"], "y": ["c", "d"]}
    with pytest.raises(ValueError, match="predictions"):
        P.pair_predictions(a, b, 3)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, base), (2, base.upper() + " !"), (3, base + " x"), (4, base[:60]), (5, None), (6, ""), (7, "a b"), (8, "A, b")], "id bigint, t string")
    sets, members = N.distinct_sets(rows, "id", "t")
    assert {(r.set_id, r.id) for r in members.collect()} == {(1, 1), (1, 2), (3, 3), (4, 4), (7, 7), (7, 8)}
    pairs = N.near_pairs(sets)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 3)]
    assert {r.set_id: r.kept for r in N.greedy_leaders(sets, pairs).collect()} == {1: True, 3: False, 4: True, 7: True}


def test_greedy_order(spark):
    sets = spark.createDataFrame([(i, []) for i in range(1, 6)], "set_id bigint, shingles array<bigint>")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (4, 5, 0.9)], "a bigint, b bigint, jaccard double")
    assert {r.set_id: r.kept for r in N.greedy_leaders(sets, pairs).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_subword_round_trip(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from bitloom.functions import subword

    path = tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([("Az őrült szép nap.",), ("",), (None,)], "t string")
    pieces = rows.select("t", subword.encode(F.col("t"), path).alias("p"))
    assert [(r.t, r.d) for r in pieces.select("t", subword.decode(F.col("p"), path).alias("d")).collect()] == [("Az őrült szép nap.",) * 2, ("", ""), (None, None)]


def test_meteor():
    from bitloom.operators.scoring import meteor

    assert meteor("a b c d".split(), "a b c d".split()) == pytest.approx(1 - 0.5 / 64)
    assert meteor([], ["a"]) == meteor(["a"], []) == meteor(["a"], ["b"]) == 0
    # two chunks: "the cat" and "sat"
    p, r = 3 / 4, 3 / 5
    assert meteor("the cat quietly sat".split(), "the cat on it sat".split()) == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (2 / 3) ** 3))


def test_train_configs(tmp_path):
    from bitloom.sources.tables import read_config, write_train_configs

    for name in ("train.hu", "train.en", "valid-a.hu", "valid-a.en", "x.sp"):
        write(tmp_path / "corpora/one" / name, "x\n")
    (at,) = write_train_configs({"steps": 10}, f"{tmp_path}/corpora", f"{tmp_path}/out", "hu", "en")
    config = read_config(at)
    assert at.endswith("run-huen-one/config.yaml") and config["steps"] == 10
    assert set(config["data"]) == {"train", "valid_a"} and config["data"]["train"]["path_tgt"].endswith("train.en")
    write(tmp_path / "corpora/one/y.txt", "x")
    with pytest.raises(ValueError, match="neither"):
        write_train_configs({}, f"{tmp_path}/corpora", f"{tmp_path}/out", "hu", "en")
