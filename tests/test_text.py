import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions.words import has_letter, words


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('"Ez egy idézet"', "Ez egy idézet"), ("'Ez egy idézet'", "Ez egy idézet"), ("`Ez egy idézet`", "Ez egy idézet"),
        ("\"'`Ez egy idézet`'\"", "Ez egy idézet"), ("'Ez egy idézet`\"", "Ez egy idézet"), ("-Ez egy idézet", "Ez egy idézet"), ("\xadEz", "Ez"), ("", ""), ('"', ""),
    ],
)
def test_clean_sentence(before, after, spark):
    row = spark.createDataFrame([(before,)], "t string").select(T.clean_sentence(F.col("t")).alias("t")).first()
    assert row.t == after


def test_clean_sentence_keeps_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.clean_sentence(F.col("t")).alias("t")).first().t is None


def test_words_and_lengths(spark):
    rows = spark.createDataFrame([("",), ("  ",), ("a\xa0b c",), (" a  b ",), (None,)], "t string")
    got = rows.select(T.word_count(F.col("t")).alias("n"), T.blank_count(F.col("t")).alias("m"), T.strip_all(F.col("t")).alias("s")).collect()
    assert [r.n for r in got] == [0, 0, 3, 2, None]
    assert [r.m for r in got] == [1, 3, 1, 5, None]
    assert [r.s for r in got] == ["", "", "a\xa0b c", "a  b", None]


def test_labels_and_keys(spark):
    rows = spark.createDataFrame([("a_b_12", "nsubj:PASS", "__label__hu")], "k string, l string, i string")
    r = rows.select(T.key_form(F.col("k")).alias("f"), T.key_index(F.col("k")).alias("n"), T.main_label(F.col("l")).alias("l"), T.iso_code(F.col("i")).alias("i")).first()
    assert (r.f, r.n, r.l, r.i) == ("a_b", 12, "nsubj", "hu")
    assert spark.createDataFrame([("x",)], "k string").select(T.key_index(F.col("k")).alias("n")).first().n is None


def test_words_are_runs_of_letters_and_digits():
    assert words("Ő-ŰT a_b ½x, 3.5!") == ["ő", "űt", "a", "b", "½x", "3", "5"]
    assert words(None) == words("") == []
    assert words("İstanbul") == ["i̇stanbul"]
    assert has_letter("12 é") and not has_letter("½ 12 -") and not has_letter(None)
