import itertools
import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import trees as R
from bitloom.operators import augment as A
from bitloom.operators import filters as L
from bitloom.operators.tree_similarity import Edge, Tree, edge_jaccard, edit_distance, ged_similarity, map_edges, pair_similarity, sequence_distance
from bitloom.sources import dep_trees as S

ONE = Tree({i: f"tag{i}" for i in range(1, 7)}, [Edge(1, 2, "dep1"), Edge(1, 3, "dep2"), Edge(2, 4, "dep3"), Edge(2, 5, "dep4"), Edge(3, 6, "dep5")])
TWO = Tree({1: "tag1", 2: "tag2", 3: "tag3", 4: "tag4", 5: "tag5", 6: "tag2"}, [Edge(1, 2, "dep1"), Edge(1, 3, "dep1"), Edge(2, 4, "dep3"), Edge(3, 5, "dep4"), Edge(3, 6, "dep3")])


def test_edge_mapping_of_toy_trees():
    assert len(map_edges(ONE, TWO)) == 3
    assert edge_jaccard(ONE, TWO) == pytest.approx(0.4286, abs=1e-4)
    assert edge_jaccard(Tree({1: "A"}, []), Tree({1: "B"}, [])) == 1


def test_edit_distance_of_toy_trees():
    assert edit_distance(ONE, TWO) == (8.0, False)
    assert ged_similarity(ONE, TWO) == (pytest.approx(0.6364, abs=1e-4), False)
    assert ged_similarity(Tree({**ONE.upos, 1: "new"}, ONE.edges), TWO)[0] == pytest.approx(0.5909, abs=1e-4)
    distance, cut = edit_distance(ONE, TWO, max_expansions=1)
    assert cut and distance >= 8.0
    assert ged_similarity(ONE, TWO, (1,))[1]


def every_distance(one, two):
    """The least cost over all assignments of nodes, root to root."""
    node = lambda p: 0 if p == "PUNCT" else 1
    edge = lambda e: 0 if e.label == "punct" else 1
    left, right = [n for n in one.upos if n != one.root], [n for n in two.upos if n != two.root]
    best = float("inf")
    for k in range(min(len(left), len(right)) + 1):
        for chosen in itertools.combinations(left, k):
            for images in itertools.permutations(right, k):
                to = {one.root: two.root, **dict(zip(chosen, images, strict=True))}
                cost = sum(0 if one.upos[a] == two.upos[b] else 2 for a, b in to.items())
                cost += sum(node(p) for n, p in one.upos.items() if n not in to) + sum(node(p) for n, p in two.upos.items() if n not in to.values())
                met = {(e.source, e.target): e for e in two.edges}
                for e in one.edges:
                    other = met.pop((to.get(e.source), to.get(e.target)), None)
                    cost += edge(e) if other is None else 0 if other.main == e.main else 2
                best = min(best, cost + sum(map(edge, met.values())))
    return best


def test_edit_distance_against_all_assignments():
    rng = random.Random(11)

    def tree():
        n = rng.randint(1, 5)
        upos = {i: rng.choice(["N", "V", "PUNCT"]) for i in range(n)}
        return Tree(upos, [Edge(rng.randrange(i), i, rng.choice(["obj", "nsubj", "punct", "obj:x"])) for i in range(1, n)])

    for _ in range(300):
        one, two = tree(), tree()
        assert edit_distance(one, two) == (every_distance(one, two), False)
        assert edit_distance(one, two, 2)[0] >= edit_distance(one, two)[0]


def test_mapping_is_one_to_one_and_bounded():
    rng = random.Random(1)
    for _ in range(50):
        trees = []
        for _ in range(2):
            n = rng.randint(1, 9)
            trees.append(Tree({i: rng.choice("NVA") for i in range(n)}, [Edge(rng.randrange(i), i, rng.choice(["nsubj", "obj", "nmod:of", "PUNCT"])) for i in range(1, n)]))
        mapped = map_edges(*trees)
        assert len({b for _, b in mapped}) == len(mapped)
        assert all(a.main == b.main for a, b in mapped)
        assert 0 <= edge_jaccard(*trees) <= 1
        same, _ = edit_distance(trees[0], trees[0])
        assert same == 0


def test_sequence_distance():
    assert sequence_distance(["a", "b"], ["a", "c", "b"]) == 1
    assert sequence_distance([], ["a"]) == 1
    assert pair_similarity("ged", None, []) == (None, False)
    with pytest.raises(ValueError, match="unknown"):
        pair_similarity("x", [{"id": 1, "upos": "A", "head": 0, "deprel": "r"}], [{"id": 1, "upos": "A", "head": 0, "deprel": "r"}])


def tok(*rows):
    return [dict(zip(("id", "form", "lemma", "upos", "head", "deprel"), r, strict=True)) for r in rows]


LIKE = tok((1, "I", "I", "PRON", 2, "nsubj"), (2, "like", "like", "VERB", 0, "root"), (3, "ice", "ice", "NOUN", 4, "compound"), (4, "cream", "cream", "NOUN", 2, "obj"), (5, "!", "!", "PUNCT", 2, "punct"))
LOVE = tok((1, "He", "he", "PRON", 2, "nsubj"), (2, "loves", "love", "VERB", 0, "ROOT"), (3, "your", "you", "PRON", 5, "nmod:poss"), (4, "huge", "huge", "ADJ", 5, "amod"), (5, "ego", "ego", "NOUN", 2, "obj"), (6, ".", ".", "PUNCT", 2, "punct"))
GAP = tok((1, "cream", "cream", "NOUN", 3, "obj"), (2, "I", "I", "PRON", 3, "nsubj"), (3, "like", "like", "VERB", 0, "root"), (4, "ice", "ice", "NOUN", 1, "compound"))
TWO_OBJ = [*LIKE, {"id": 6, "form": "x", "lemma": "x", "upos": "NOUN", "head": 2, "deprel": "obj"}]
NO_OBJ = [t | {"deprel": "obl"} if t["deprel"] == "obj" else t for t in LIKE]
VERB_OBJ = [t | {"upos": "VERB"} if t["deprel"] == "obj" else t for t in LIKE]
OTHER_HEAD = [t | {"head": 5} if t["deprel"] == "nsubj" else t for t in LIKE]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, LIKE, LIKE), (2, LOVE, LOVE), (3, GAP, LIKE), (4, LIKE, TWO_OBJ), (5, NO_OBJ, LIKE), (6, LIKE, VERB_OBJ), (7, LIKE, OTHER_HEAD), (8, [], LIKE)]
    return L.with_spans(spark.createDataFrame(rows, f"pair_id bigint, src_tokens array<{R.TOKEN}>, tgt_tokens array<{R.TOKEN}>"))


def test_eligibility(pairs):
    got = {r.pair_id: (r.o, r.n, r.b) for r in pairs.select("pair_id", L.eligible("obj").alias("o"), L.eligible("nsubj").alias("n"), L.eligible_both().alias("b")).collect()}
    assert got[1] == got[2] == (True, True, True)
    assert got[3] == (False, True, False)  # the object has a gap
    assert got[4] == (False, True, False)  # two objects in the target
    assert got[5] == (False, True, False)  # no object in the source
    assert got[6][0] is False  # parts of speech differ
    assert got[7] == (True, True, False)  # different predicates
    assert got[8] == (False, False, False)  # empty tree
    loose = {r.pair_id: r.o for r in pairs.select("pair_id", L.eligible("obj", same_pos=False).alias("o")).collect()}
    assert loose[6]
    nouns = {r.pair_id: r.n for r in pairs.select("pair_id", L.eligible("nsubj", nouns=True).alias("n")).collect()}
    assert not nouns[1]


def swapped(pairs, spark, dep):
    draws = spark.createDataFrame([(0, 1, 2)], "draw bigint, pair_a bigint, pair_b bigint")
    rows = A.swap_pairs(pairs.where("pair_id <= 2"), draws, dep, dep).orderBy("slot").collect()
    assert all(r.src == r.tgt for r in rows)
    return [r.src for r in rows]


def test_swaps(pairs, spark):
    assert swapped(pairs, spark, "obj") == ["I like your huge ego !", "He loves ice cream ."]
    assert swapped(pairs, spark, "nsubj") == ["He like ice cream !", "I loves your huge ego ."]
    assert swapped(pairs, spark, "predicate") == ["I loves ice cream !", "He like your huge ego ."]


def test_swap_keeps_all_tokens_and_originals(pairs, spark):
    draws = spark.createDataFrame([(0, 1, 2)], "draw bigint, pair_a bigint, pair_b bigint")
    rows = A.swap_pairs(pairs.where("pair_id <= 2"), draws, "obj", "m", save_original=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.method, []).extend(r.src.split())
    assert sorted(by["m"]) == sorted(by["original_m"])


def test_target_pairs():
    assert A.target_pairs(5, 0.5) == 1
    assert A.target_pairs(100, 0.5) == 25
    assert A.target_pairs(100, 0.5, size=10) == 5
    assert A.target_pairs(100, 0.5, multiplier=1.5) == 37


def test_same_pairs_on_any_partitioning(spark):
    from bitloom.operators.joins import draw_pairs, sampled_pairs

    ids = spark.range(40).withColumnRenamed("id", "pair_id")
    a = {(r.draw, r.pair_a, r.pair_b) for r in sampled_pairs(ids.repartition(7), "pair_id", 30, 5).collect()}
    b = {(r.draw, r.pair_a, r.pair_b) for r in sampled_pairs(ids.coalesce(1), "pair_id", 30, 5).collect()}
    assert a == b
    assert len({(x, y) for _, x, y in a}) == 30
    assert all(x != y for _, x, y in a)
    assert draw_pairs(3, 100, 1, spark).count() == 6
    assert draw_pairs(1, 5, 1, spark).count() == draw_pairs(0, 5, 1, spark).count() == 0


def test_threshold_falls_until_enough_pairs(spark):
    rows = spark.createDataFrame([(i, i / 20) for i in range(20)], "pair_id bigint, similarity double")
    strict = A.thresholded_pairs(rows, 4, 0.9, 3).collect()
    assert len(strict) == 4
    assert A.thresholded_pairs(rows.limit(0), 4, 0.9, 3).count() == 0


def test_threshold_ends_by_the_pairs_that_exist(spark):
    # 4 of 40,000 members reach the floor: all their 12 pairs are found, although a draw hardly ever meets them
    rows = spark.range(40_000).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 4, 0.01 * (1 + F.col("id"))).otherwise(0.0).alias("similarity"))
    got = {(r.pair_a, r.pair_b) for r in A.thresholded_pairs(rows, 100, 0.5, 3).collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if a != b}
    # half of the members reach the first threshold: three quarters of the draws fail, so most pairs come from above it
    rows = spark.range(2000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.3).alias("similarity"))
    got = A.thresholded_pairs(rows.repartition(5), 300, 0.5, 3).collect()
    assert len({(r.pair_a, r.pair_b) for r in got}) == 300
    assert got and {r.draw: (r.pair_a, r.pair_b) for r in got} == {r.draw: (r.pair_a, r.pair_b) for r in A.thresholded_pairs(rows.coalesce(1), 300, 0.5, 3).collect()}
    assert all(r.pair_a % 2 == r.pair_b % 2 == 0 for r in got)


def test_depth_operators(spark):
    rows = spark.createDataFrame([(1, LIKE), (2, [])], f"id bigint, tokens array<{R.TOKEN}>")
    got = rows.select("id", A.depth_probabilities(F.col("tokens")).alias("p")).orderBy("id").collect()
    assert sum(got[0].p) == pytest.approx(1)
    assert got[0].p[1] == min(got[0].p)  # the root word
    assert got[1].p == []
    at = A.chosen_positions(A.depth_probabilities(F.col("tokens")), 7, F.col("id"))
    r = rows.where("id = 1").select(at.alias("at"), A.blank_words(F.col("tokens"), at).alias("b"), A.drop_words(F.col("tokens"), at).alias("d")).first()
    assert 1 <= len(r.at) <= 3
    assert r.b.split().count("[BLANK]") == len(r.at)
    assert len(r.d.split()) == 5 - len(r.at)
    with pytest.raises(NotImplementedError):
        A.replace_words()


def test_tree_files_round_trip(spark, tmp_path):
    trees = spark.createDataFrame([(0, LIKE), (1, []), (2, LOVE)], f"pair_id bigint, tokens array<{R.TOKEN}>")
    S.write_trees(trees, f"{tmp_path}/t", per_file=2)
    files = {p.parent.name: p.read_text() for p in (tmp_path / "t").rglob("*.txt")}
    assert set(files) == {"batch=1", "batch=2"}
    assert files["batch=1"].startswith("I_1\tPRON\tI\tnsubj\tlike_2\tVERB\tlike\n")
    assert "\troot\troot_0\tNone\tNone\n" in files["batch=1"]
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "10.tsv").write_text(files["batch=2"])
    (flat / "2.tsv").write_text(files["batch=1"])
    back = {r.pair_id: r.tokens for r in S.read_trees(spark, f"{flat}/*.tsv").collect()}
    assert sorted(back) == [0, 1, 2]
    assert [t.form for t in back[0]] == ["I", "like", "ice", "cream", "!"]
    assert back[1] == []
    assert back[2][1].deprel == "ROOT" and back[2][1].head == 0


def test_unended_sentence_is_none(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("a_1\tNOUN\ta\troot\troot_0\tNone\tNone\n\nb_1\tNOUN\tb\troot\troot_0\tNone\tNone\n")
    assert S.read_trees(spark, f"{tmp_path}/1.tsv").count() == 1


def test_emtsv(spark, tmp_path):
    (tmp_path / "e.txt").write_text("form\twsafter\tanas\tlemma\txpostag\tupostag\tfeats\tid\tdeprel\thead\nEz\t\"\"\t[]\tez\tX\tPRON\t_\t1\tSUBJ\t2\nvan\t\"\"\t[]\tvan\tX\tVERB\t_\t2\tROOT\t0\n\n")
    rows = S.read_emtsv(spark, f"{tmp_path}/e.txt").collect()
    assert [(t.form, t.upos, t.head) for t in rows[0].tokens] == [("Ez", "PRON", 2), ("van", "VERB", 0)]


def test_parser_provider(spark):
    def factory():
        return lambda text: [[{"id": i + 1, "form": w, "lemma": w, "upos": "X", "head": i, "deprel": "dep"} for i, w in enumerate(s.split())] for s in text.split(". ")]

    rows = spark.createDataFrame([(1, "a b c"), (2, "a. b"), (3, None), (4, "")], "id bigint, t string")
    got = {r.id: (r.n_sentences, len(r.tokens)) for r in S.parse(rows, "id", "t", "xx", factory).collect()}
    assert got == {1: (1, 3), 2: (2, 0), 3: (0, 0), 4: (0, 0)}
    with pytest.raises(ValueError, match="no parser"):
        S.parse(rows, "id", "t", "zz")
