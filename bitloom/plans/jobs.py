"""The jobs: preprocess a corpus, parse it, augment it; each stage can be run again."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions import trees as R
from bitloom.operators import augment as A
from bitloom.operators import filters as L
from bitloom.operators.reports import report_blocks
from bitloom.operators.scoring import ScoreFilter
from bitloom.scratch import materialise
from bitloom.sources import dep_trees, lines, sinks
from bitloom.sources.tables import PreprocessConfig, read_config

Identify = Callable[[Column], Column]
Parser = Callable[[], dep_trees.Parser]


def cleaned(pairs: DataFrame, config: PreprocessConfig, compat: bool = False) -> DataFrame:
    """Both sides cleaned, then their punctuation normalised, each by its own language (compat: both by the source's)."""
    langs = {"src": config.source_language, "tgt": config.source_language if compat else config.target_language}
    return pairs.withColumns({s: T.normalise_punctuation(T.clean_sentence(F.col(s)), lang) for s, lang in langs.items()})


def _limits(config: PreprocessConfig) -> dict[str, float]:
    return {"least": config.total_wordcount_min, "most": config.total_wordcount_max, "max_difference": config.wordcount_diff, "max_ratio": config.wordcount_ratio_threshold}


def in_languages(pairs: DataFrame, config: PreprocessConfig, identify: Identify | None) -> DataFrame:
    """Pairs whose sides the provider finds to be in the expected languages; without a provider all."""
    if identify is None:
        return pairs
    return pairs.where((identify(F.col("src")) == config.source_language) & (identify(F.col("tgt")) == config.target_language))


def preprocess(pairs: DataFrame, config: PreprocessConfig, identify: Identify | None = None, compat: bool = False) -> DataFrame:
    """``pair_id, src, tgt`` of the pairs that pass: cleaned, of good length in words, in the expected languages.

    Length is tested before language, so the provider sees only what passes the cheap test.
    """
    kept = L.non_empty(L.filter_by_length(cleaned(pairs, config, compat), "src", "tgt", **_limits(config)), "src", "tgt")
    return in_languages(kept, config, identify)


def preprocess_and_parse(pairs: DataFrame, config: PreprocessConfig, src_parser: Parser, tgt_parser: Parser, identify: Identify | None = None) -> DataFrame:
    """``pair_id, src, tgt, src_tokens, tgt_tokens``: cleaned pairs in the expected languages, one sentence a side, of good length in words without punctuation."""
    kept = in_languages(L.non_empty(cleaned(pairs, config), "src", "tgt"), config, identify)
    for side, lang, parser in (("src", config.source_language, src_parser), ("tgt", config.target_language, tgt_parser)):
        trees = dep_trees.parse(kept, "pair_id", side, lang, parser)
        kept = kept.join(trees.select(F.col("id").alias("pair_id"), F.col("tokens").alias(f"{side}_tokens")), "pair_id")
    counts = [R.words_without_punctuation(F.col(f"{s}_tokens")) for s in ("src", "tgt")]
    return kept.where(L.good_length(*counts, **_limits(config)))


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that stand complete below ``path``; none if nothing was written there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or not any(s.getPath().getName().startswith("batch=") for s in files.listStatus(at)):
        return []
    return sorted(r["batch"] for r in spark.read.parquet(path).select("batch").distinct().collect())


def precompute(pairs: DataFrame, path: str, config: PreprocessConfig, src_parser: Parser, tgt_parser: Parser, identify: Identify | None = None) -> int:
    """Write parsed pairs by batch of line numbers, leaving out batches that are there; the number of those.

    A batch is one partition directory that is replaced as a whole, so a run that was broken off repeats at most
    the batches that were not complete and never doubles rows.
    """
    spark = pairs.sparkSession
    done = finished_batches(spark, path)
    todo = pairs.withColumn("batch", F.floor(F.col("pair_id") / config.batch_size).cast("bigint"))
    if done:
        todo = todo.where(~F.col("batch").isin(done))
    parsed = preprocess_and_parse(todo, config, src_parser, tgt_parser, identify)
    parsed = parsed.withColumn("batch", F.floor(F.col("pair_id") / config.batch_size).cast("bigint"))
    parsed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(path)
    return len(done)


def augment(
    pairs: DataFrame, kind: str = "base", ratio: float = 0.5, size: int | None = None, threshold: float = 0.5, seed: int = 123,
    separate: bool = False, filters: list[ScoreFilter] | None = None, save_original: bool = False, **rules: bool,
) -> DataFrame:
    """Augmented pairs of all methods; kind: ``base``, or ``edge_mapper`` / ``ged`` (these need separate pools)."""
    filters = filters or []
    if kind == "base":
        factor = 1.0
        for f in filters:
            factor *= f.multiplier
        made = A.augment_by_swapping(pairs, ratio, size, seed, separate, factor, save_original=save_original, **rules)
    elif not separate:
        raise ValueError(f"{kind} needs separate pools")
    else:
        made = A.augment_by_similarity(pairs, kind, threshold, ratio, size, seed, **rules)
    for f in filters:
        made = f(made)
    return made


def _named(place: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = place.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    """Commands: ``preprocess CONFIG SRC TGT OUT``, ``precompute CONFIG SRC TGT OUT`` (parsing, can be run again) and
    ``augment SRC_TREES TGT_TREES OUT``."""
    parser = argparse.ArgumentParser(prog="bitloom")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preprocess")
    for name in ("config", "src", "tgt", "out"):
        p.add_argument(name)
    a = commands.add_parser("augment")
    for name in ("src_trees", "tgt_trees", "out"):
        a.add_argument(name)
    a.add_argument("--kind", default="base", choices=["base", "edge_mapper", "ged"])
    a.add_argument("--ratio", type=float, default=0.5)
    a.add_argument("--size", type=int)
    a.add_argument("--threshold", type=float, default=0.5)
    a.add_argument("--seed", type=int, default=123)
    a.add_argument("--separate", action="store_true")
    a.add_argument("--save-original", action="store_true")
    a.add_argument("--layout", default="basic", choices=["basic", "tsv"])
    a.add_argument("--nouns", action="store_true", help="a noun in each subtree")
    a.add_argument("--any-pos", action="store_true", help="heads of different parts of speech too")
    a.add_argument("--any-predicate", action="store_true", help="subject and object of different words too (base only)")
    a.add_argument("--report", help="where to write the originals with what was made of them")
    a.add_argument("--filters", help="module:function that returns the score filters")
    t = commands.add_parser("precompute")
    for name in ("config", "src", "tgt", "out"):
        t.add_argument(name)
    t.add_argument("--parser", required=True, help="module:function that registers the parsers of both languages")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("bitloom").getOrCreate()
    if args.command == "preprocess":
        config = PreprocessConfig.of(read_config(args.config))
        sinks.write_pairs(preprocess(lines.read_aligned(spark, args.src, args.tgt), config), args.out)
        return
    if args.command == "precompute":
        config = PreprocessConfig.of(read_config(args.config))
        _named(args.parser)()
        precompute(lines.read_aligned(spark, args.src, args.tgt), args.out, config, dep_trees.parser(config.source_language), dep_trees.parser(config.target_language))
        return
    src = dep_trees.read_trees(spark, args.src_trees).select("pair_id", F.col("tokens").alias("src_tokens"))
    tgt = dep_trees.read_trees(spark, args.tgt_trees).select("pair_id", F.col("tokens").alias("tgt_tokens"))
    pairs = materialise(src.join(tgt, "pair_id"))
    rules = {"nouns": args.nouns, "same_pos": not args.any_pos} | ({"same_predicate": not args.any_predicate} if args.kind == "base" else {})
    filters = _named(args.filters)() if args.filters else None
    made = materialise(augment(pairs, args.kind, args.ratio, args.size, args.threshold, args.seed, args.separate, filters, save_original=args.save_original, **rules))
    sinks.write_augmented(made, args.out, args.layout)
    if args.report:
        plain = pairs.select("pair_id", R.sentence(F.col("src_tokens")).alias("src"), R.sentence(F.col("tgt_tokens")).alias("tgt"))
        report_blocks(made.where(~F.col("method").startswith("original_")), plain).select(F.col("report").alias("value")).write.mode("overwrite").text(args.report)


if __name__ == "__main__":
    main()
