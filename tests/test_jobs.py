import pytest
from pyspark.sql import functions as F

from bitloom.functions import trees as R
from bitloom.operators.scoring import QuantileFilter
from bitloom.plans import jobs
from bitloom.sources import dep_trees
from bitloom.sources.tables import PreprocessConfig
from bitloom.streaming import incremental

CONFIG = PreprocessConfig("hu", "en", 0, 32, 7, 1.2, batch_size=3)


def fake_parser():
    def parse(text):
        return [[{"id": i + 1, "form": w, "lemma": w.lower(), "upos": "PUNCT" if w == "." else "X", "head": i, "deprel": "root" if i == 0 else "dep"} for i, w in enumerate(s.split())] for s in text.split(" | ")]

    return parse


def one_filter():
    return [QuantileFilter(F.col("draw") * 2 + F.col("slot"), F.col("draw") * 2 + F.col("slot"), 0.0)]


def register():
    dep_trees.register_parser("hu", fake_parser)
    dep_trees.register_parser("en", fake_parser)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(0, '"Ez egy idézet"', "-This is a quote"), (1, "A kutya ugat .", "The dog barks ."), (2, "the dog", "a kutya"), (3, "", "x"), (4, None, "x"), (5, "szó " * 40, "word " * 40), (6, "egy | kettő", "one two"), (7, "egy kettő", "one two")]
    return spark.createDataFrame(rows, "pair_id bigint, src string, tgt string")


def identify(c):
    return F.when(c.rlike("(?i)the|one|this"), "en").otherwise("hu")


def test_preprocess(pairs):
    got = {r.pair_id: (r.src, r.tgt) for r in jobs.preprocess(pairs, CONFIG, identify).collect()}
    assert got == {0: ("Ez egy idézet", "This is a quote"), 1: ("A kutya ugat .", "The dog barks ."), 6: ("egy | kettő", "one two"), 7: ("egy kettő", "one two")}
    assert jobs.preprocess(pairs, CONFIG).count() == 5


def test_precompute_resumes(pairs, spark, tmp_path):
    out = f"{tmp_path}/parsed"
    assert jobs.precompute(pairs.where("pair_id < 3"), out, CONFIG, fake_parser, fake_parser, identify) == 0
    assert jobs.precompute(pairs, out, CONFIG, fake_parser, fake_parser, identify) == 1
    rows = spark.read.parquet(out).orderBy("pair_id").collect()
    assert [r.pair_id for r in rows] == [0, 1, 7]
    assert [r.batch for r in rows] == [0, 0, 2]
    assert len(rows[1].src_tokens) == 4


def test_augment_rules(spark):
    none = spark.createDataFrame([], f"pair_id bigint, src_tokens array<{R.TOKEN}>, tgt_tokens array<{R.TOKEN}>")
    assert jobs.augment(none).count() == 0
    assert jobs.augment(none, "edge_mapper", separate=True).count() == 0
    with pytest.raises(ValueError, match="separate"):
        jobs.augment(none, "ged")


def test_command_line(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("source_language: hu\ntarget_language: en\n")
    (tmp_path / "s").write_text("egy\nkettő\n")
    (tmp_path / "t").write_text("'one'\ntwo\n")
    jobs.main(["preprocess", f"{tmp_path}/c.yaml", f"{tmp_path}/s", f"{tmp_path}/t", f"{tmp_path}/out"])
    assert spark.read.text(f"{tmp_path}/out/tgt").orderBy("value").first().value == "one"
    jobs.main(["precompute", f"{tmp_path}/c.yaml", f"{tmp_path}/s", f"{tmp_path}/t", f"{tmp_path}/parsed", "--parser", "tests.test_jobs:register"])
    assert spark.read.parquet(f"{tmp_path}/parsed").count() == 2
    tree = "I_1\tPRON\tI\tnsubj\tlike_2\tVERB\tlike\nlike_2\tVERB\tlike\tROOT\troot_0\tNone\tNone\n{0}_3\tNOUN\t{0}\tobj\tlike_2\tVERB\tlike\n\n"
    (tmp_path / "trees").write_text("".join(tree.format(w) for w in ("tea", "ice", "jam", "pie")))
    jobs.main(["augment", f"{tmp_path}/trees", f"{tmp_path}/trees", f"{tmp_path}/made", "--ratio", "1", "--nouns", "--report", f"{tmp_path}/report", "--layout", "tsv", "--any-pos"])
    assert spark.read.text(f"{tmp_path}/made").count() == 0  # a subject without a noun
    jobs.main(["augment", f"{tmp_path}/trees", f"{tmp_path}/trees", f"{tmp_path}/made", "--ratio", "1", "--layout", "tsv", "--report", f"{tmp_path}/report"])
    assert spark.read.text(f"{tmp_path}/made").count() == 8
    jobs.main(["augment", f"{tmp_path}/trees", f"{tmp_path}/trees", f"{tmp_path}/kept", "--ratio", "1", "--layout", "tsv", "--filters", "tests.test_jobs:one_filter"])
    assert 0 < spark.read.text(f"{tmp_path}/kept").count() < 8
    assert spark.read.text(f"{tmp_path}/report", wholetext=True).where("value like 'I like %'").count() > 0


def test_increments(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, f"a {i % 3}", "b", None) for i in range(6)], incremental.BITEXT)
    rows.write.parquet(source)
    clean = lambda d: jobs.preprocess(d, CONFIG)
    incremental.run_increments(incremental.stream_pairs(spark, source), clean, out, state).awaitTermination()
    rows.withColumn("pair_id", F.col("pair_id") + 10).write.mode("append").parquet(source)
    incremental.run_increments(incremental.stream_pairs(spark, source), clean, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 12 and got.select("pair_id").distinct().count() == 12
    q = incremental.first_arrivals(incremental.stream_pairs(spark, source), ["src"]).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3
    dated = rows.withColumn("ingested_at", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("pair_id") * 1800))
    assert incremental.arrivals_by_window(dated, "src").agg(F.sum("n")).first()[0] == 6
