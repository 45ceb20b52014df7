"""Dependency trees as files: the seven-column form, the emtsv form, and parsing by a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.trees import TOKEN, trees_from_edges
from bitloom.sources.lines import natural_key, raw_lines

# fixed values: the columns of the tree files
TREE_COLUMNS = ("target_key", "target_postag", "target_lemma", "target_deprel", "source_key", "source_postag", "source_lemma")
EMTSV_COLUMNS = ("form", "wsafter", "anas", "lemma", "xpostag", "upostag", "feats", "id", "deprel", "head")


def _numbered_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, files). lines: ``file``, ``value``, ``first`` (whether it is the first of its file), ``block`` (blank lines
    before it in its file); files: ``file``, ``n`` (its blank lines), ``offset`` (those of all files before it).

    Files are in natural order of their paths. Blank lines are counted by split of a file (one row each) and running
    within a split, so no task sees more than a split.
    """
    lines = raw_lines(spark, path).withColumn("blank", (F.col("value") == "").cast("int"))
    splits = lines.groupBy("file", "split").agg(F.sum("blank").alias("n"), F.min("at").alias("begin"))
    own = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "split", "begin", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    running = lines.withColumn("k", F.coalesce(F.sum("blank").over(within), F.lit(0)))
    placed = running.join(offsets, ["file", "split"])
    first = (F.col("split") == 0) & (F.col("at") == F.col("begin"))
    totals = splits.groupBy("file").agg(F.sum("n").alias("n"))
    order = Window.orderBy(natural_key(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = totals.withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return placed.select("file", "value", first.alias("first"), (F.col("before") + F.col("k")).alias("block")), files


def read_trees(spark: SparkSession, path: str, side: str = "src") -> DataFrame:
    """``pair_id, side, tokens``: the sentences of all files in natural order of the paths, numbered from 0.

    A blank line ends a sentence; two in a row are an empty sentence, which keeps its number and has no tokens; what
    follows the last blank line of a file is no sentence.
    """
    lines, files = _numbered_blocks(spark, path)
    cells = F.split("value", "\t")
    edges = lines.where("value <> ''").join(files, "file").where("block < n")
    edges = edges.select((F.col("offset") + F.col("block")).alias("pair_id"), *(F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(TREE_COLUMNS)))
    trees = trees_from_edges(edges, ("pair_id",))
    every = lines.where("value = ''").join(files, "file").select((F.col("offset") + F.col("block")).alias("pair_id"))
    return every.join(trees, "pair_id", "left").select("pair_id", F.lit(side).alias("side"), F.coalesce("tokens", F.array().cast(f"array<{TOKEN}>")).alias("tokens"))


def read_emtsv(spark: SparkSession, path: str) -> DataFrame:
    """``file, pair_id, tokens`` of emtsv output: columns by the names in the header row, sentences end at blank lines."""
    lines, _ = _numbered_blocks(spark, path)
    header = lines.where("first").select("file", F.split("value", "\t").alias("h"))
    rows = lines.where("not first and value <> ''").join(header, "file").withColumn("c", F.split("value", "\t"))
    cell = lambda name: F.get("c", F.array_position("h", name).cast("int") - 1)
    token = F.struct(cell("id").cast("int").alias("id"), cell("form").alias("form"), cell("lemma").alias("lemma"), cell("upostag").alias("upos"), cell("head").cast("int").alias("head"), cell("deprel").alias("deprel"))
    return rows.select("file", "block", token.alias("t")).groupBy("file", "block").agg(F.array_sort(F.collect_list("t")).alias("tokens")).select("file", F.col("block").alias("pair_id"), "tokens")


def to_edges(trees: DataFrame, *keys: str) -> DataFrame:
    """Trees in the long form: one row a token with the seven columns."""
    t, none = F.col("t"), F.lit(None).cast("string")
    head = F.try_element_at(F.filter("tokens", lambda x: x["id"] == F.col("t.head")), F.lit(1))
    rows = trees.select(*keys, "tokens", F.explode("tokens").alias("t"))
    at_root = t["head"] == 0
    return rows.select(
        *keys,
        t["id"].alias("tok_no"),
        F.concat_ws("_", t["form"], t["id"]).alias("target_key"),
        t["upos"].alias("target_postag"),
        t["lemma"].alias("target_lemma"),
        t["deprel"].alias("target_deprel"),
        F.when(at_root, F.lit("root_0")).otherwise(F.concat_ws("_", head["form"], t["head"])).alias("source_key"),
        F.when(at_root, none).otherwise(head["upos"]).alias("source_postag"),
        F.when(at_root, none).otherwise(head["lemma"]).alias("source_lemma"),
    )


def render(tokens_df: DataFrame) -> DataFrame:
    """``pair_id``, ``value``: the text of each sentence as in a tree file (its lines; a blank line is added on writing)."""
    edges = to_edges(tokens_df, "pair_id")
    line = F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit("None")) for c in TREE_COLUMNS))
    text = edges.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("tok_no", line.alias("line")))).alias("l"))
    full = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return tokens_df.select("pair_id").join(text.select("pair_id", full.alias("value")), "pair_id", "left").na.fill("", ["value"])


def write_trees(trees: DataFrame, path: str, per_file: int) -> None:
    """One directory ``batch=<n>`` (from 1) of each ``per_file`` sentences, sentences in order, a blank line after every one.

    pair_id must count from 0. Each batch is one file.
    """
    rows = render(trees).withColumn("batch", F.floor(F.col("pair_id") / per_file).cast("int") + 1)
    rows.repartition("batch").sortWithinPartitions("batch", "pair_id").select("batch", "value").write.partitionBy("batch").mode("overwrite").text(path)


Parser = Callable[[str], list[list[dict]]]
_parsers: dict[str, Callable[[], Parser]] = {}


def register_parser(language: str, factory: Callable[[], Parser]) -> None:
    """Make a parser known: the factory is called once a task and returns text -> sentences of tokens."""
    _parsers[language] = factory


def parser(language: str) -> Callable[[], Parser]:
    """The registered factory of a language."""
    if language not in _parsers:
        raise ValueError(f"no parser is registered for {language!r}")
    return _parsers[language]


def parse(rows: DataFrame, id_col: str, text_col: str, language: str, factory: Callable[[], Parser] | None = None) -> DataFrame:
    """``id``, ``n_sentences``, ``tokens``: trees by the provider of a language; texts of more than one sentence give none."""
    make = factory or parser(language)
    base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_of = make()
        for pdf in it:
            found = [trees_of(t) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_sentences": [len(f) for f in found], "tokens": [f[0] if len(f) == 1 else [] for f in found]})

    return base.mapInPandas(run, f"id {dict(base.dtypes)['id']}, n_sentences int, tokens array<{TOKEN}>")
