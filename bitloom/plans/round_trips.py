"""Queries of sources and sinks: tables are written by a sink, read back by a source, and compared with themselves in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions import trees as R
from bitloom.operators import augment as A
from bitloom.operators import filters as L
from bitloom.operators import sampling as M
from bitloom.operators import scoring as S
from bitloom.plans.reference_queries import SEED, TOK, TREE, _h, _next_pairs, _pool, _swap_sql, _t, _trees, md5_sql, query, strip_sql
from bitloom.scratch import materialise, scratch_path
from bitloom.sources import dep_trees, lines, sinks, tables


def _line_sql(x: str) -> str:
    return f"translate(coalesce({x}, ''), chr(13) || chr(10) || chr(9), '   ')"


def _read_sql(x: str) -> str:
    return strip_sql(_line_sql(x))


_ROWS = f"l AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS pair_id, {_read_sql('hun')} AS src, {_read_sql('eng')} AS tgt FROM hunglish_sampler)"


def _written(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark)
    sinks.write_pairs(_h(spark, sf), path, src="hun", tgt="eng")
    return path


@query(f"WITH {_ROWS} SELECT * FROM l")
def io_aligned(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, sf)
    return lines.read_aligned(spark, f"{path}/src", f"{path}/tgt")


@query(f"WITH {_ROWS} SELECT *, pair_id // 100 AS batch FROM l WHERE pair_id >= 200")
def io_batches(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, sf)
    return lines.read_aligned_batches(spark, f"{path}/src", f"{path}/tgt", 100, skip=2)


@query(f"WITH {_ROWS} SELECT pair_id, src || chr(9) || tgt AS value FROM l")
def io_combined(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, sf)
    return lines.read_combined(spark, f"{path}/src", f"{path}/tgt")


@query(f"""WITH {_ROWS}, a AS (SELECT 'src' AS side, src AS value FROM l UNION ALL SELECT 'src', src FROM l UNION ALL SELECT 'tgt', tgt FROM l UNION ALL SELECT 'tgt', tgt FROM l)
SELECT side, value, count(*) AS n FROM a GROUP BY 1, 2""")
def io_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice, the second time behind the first."""
    path = _written(spark, sf)
    sinks.write_pairs(_h(spark, sf), path, append=True, src="hun", tgt="eng")
    sides = [lines.read_lines(spark, f"{path}/{s}").select(F.lit(s).alias("side"), "value") for s in ("src", "tgt")]
    return sides[0].unionByName(sides[1]).groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_number() OVER (ORDER BY pair_id % 12, pair_id) - 1 AS line_no, {_read_sql('eng')} AS value FROM hunglish_sampler")
def io_many_files(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve directories 0 .. 11, read in natural order (2 before 10)."""
    path = scratch_path(spark)
    rows = _h(spark, sf).select((F.col("pair_id") % 12).alias("part"), "pair_id", sinks.one_line("eng").alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "pair_id").select("part", "value").write.partitionBy("part").text(path)
    return lines.read_lines(spark, path)


_DOMAIN = "lower(trim(domain))"


@query(f"""WITH l AS (SELECT 'domain=' || {_DOMAIN} AS domain, {_line_sql('hun')} AS hun, {_line_sql('eng')} AS eng FROM hunglish_sampler WHERE domain IS NOT NULL)
SELECT domain, hun, eng, count(*) AS n FROM l GROUP BY ALL""")
def io_domains(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_domains(_h(spark, sf).where("domain is not null").withColumn("domain", T.folded_name(F.col("domain"))), path)
    rows, _ = lines.read_tsv_bitext(spark, path, encoding="UTF-8")
    return rows.groupBy("domain", "hun", "eng").agg(F.count(F.lit(1)).alias("n"))


_LATIN2 = "".join(bytes([b]).decode("iso8859-2") for b in range(160, 256))


@query(f"""WITH l AS (SELECT pair_id, regexp_replace({_line_sql('hun')}, '[^\\x00-\\x7F{_LATIN2}]', '?', 'g') AS hun, regexp_replace({_line_sql('eng')}, '[^\\x00-\\x7F{_LATIN2}]', '?', 'g') AS eng FROM hunglish_sampler)
SELECT {strip_sql('hun')} AS hun, {strip_sql('eng')} AS eng, count(*) AS n FROM l GROUP BY 1, 2""")
def io_latin2(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of Latin-2, read in their encoding and stripped."""
    path = scratch_path(spark)
    plain = F.regexp_replace(sinks.tab_separated("hun", "eng"), f"[^\\x00-\\x7F{_LATIN2}]", "?")
    value = F.translate(plain, _LATIN2, "".join(map(chr, range(160, 256))))
    _h(spark, sf).select(F.encode(value, "ISO-8859-1").cast("string").alias("value")).write.text(f"{path}/some/file")
    rows, _ = lines.read_tsv_bitext(spark, path, encoding="ISO-8859-2", trim=True)
    return rows.groupBy("hun", "eng").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {md5_sql("'split'", 'CAST(pair_id AS VARCHAR)')}, pair_id) AS r FROM hunglish_sampler)
SELECT CASE WHEN r <= 20 THEN 'test' WHEN r <= 50 THEN 'valid' ELSE 'train' END AS new_split, nullif({_line_sql('hun')}, '') AS hun, nullif({_line_sql('eng')}, '') AS eng, count(*) AS n FROM s GROUP BY ALL""")
def io_splits(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_splits(M.split_by_group(_h(spark, sf), "domain", "pair_id", 20, 30, SEED), path)
    rows = tables.read_delimited(spark, path, "hun string, eng string, new_split string", sep="\t", header=False, quote="")
    return rows.groupBy("new_split", "hun", "eng").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, source_file, domain, author, series FROM source_catalog")
def io_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_table(_t(spark, sf, "source_catalog").select("source_id", "source_file", "domain", "author", "series"), path)
    return spark.read.parquet(path)


@query("SELECT 'test' AS corpus, text AS en, ref_text AS hu FROM eval_item")
def io_translations(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    items = _t(spark, sf, "eval_item")
    items.select("item_id", F.struct(F.col("text").alias("en"), F.col("ref_text").alias("hu")).alias("translation")).write.json(path)
    return lines.read_translations(spark, path, "test")


def _side(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """The trees of a side, numbered from 0 in the order of their ids (one row a tree is ranked)."""
    trees = _trees(spark, sf).where(F.col("side") == side)
    place = trees.select("pair_id", (F.row_number().over(Window.orderBy("pair_id")) - 1).cast("bigint").alias("place"))
    return trees.join(place, "pair_id").select(F.col("place").alias("pair_id"), "tokens")


_NUMBERED = f"WITH {TOK}, n AS (SELECT *, dense_rank() OVER (ORDER BY pair_id) - 1 AS place FROM tok WHERE side = 'hun')"


@query(f"{_NUMBERED} SELECT place AS pair_id, id, form, lemma, upos, head, deprel FROM n")
def io_trees(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    dep_trees.write_trees(_side(spark, sf, "hun"), path, 7)
    rows = dep_trees.read_trees(spark, path).select("pair_id", F.explode("tokens").alias("t"))
    return rows.select("pair_id", "t.id", "t.form", "t.lemma", "t.upos", "t.head", "t.deprel")


@query(f"{_NUMBERED} SELECT place AS pair_id, id, form, lemma, upos, head, deprel FROM n")
def io_emtsv(spark: SparkSession, sf: str) -> DataFrame:
    """Files of ten sentences each with a header row; the sentence numbers of a file count from 0."""
    path = scratch_path(spark)
    t = F.col("t")
    by_name = {"form": t["form"], "lemma": t["lemma"], "upostag": t["upos"], "id": t["id"].cast("string"), "deprel": t["deprel"], "head": t["head"].cast("string")}
    line = F.concat_ws("\t", *(F.coalesce(by_name.get(c, F.lit("_")), F.lit("None")) for c in dep_trees.EMTSV_COLUMNS))
    rows = _side(spark, sf, "hun").select("pair_id", F.explode("tokens").alias("t")).select("pair_id", t["id"].alias("id"), line.alias("line"))
    text = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"))
    full = text.select(F.floor(F.col("pair_id") / 10).alias("part"), "pair_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))
    header = full.select("part", F.lit(-1).cast("bigint").alias("pair_id"), F.lit("\t".join(dep_trees.EMTSV_COLUMNS)).alias("value")).distinct()
    full.unionByName(header).repartition("part").sortWithinPartitions("part", "pair_id").select("part", "value").write.partitionBy("part").text(path)
    got = dep_trees.read_emtsv(spark, path).withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint"))
    rows = got.select((F.col("part") * 10 + F.col("pair_id")).alias("pair_id"), F.explode("tokens").alias("t"))
    return rows.select("pair_id", "t.id", "t.form", R.none_to_null(F.col("t.lemma")).alias("lemma"), R.none_to_null(F.col("t.upos")).alias("upos"), "t.head", "t.deprel")


def _augmented_sql(columns: str) -> str:
    return f"WITH x AS ({_swap_sql('obj', 'obj_swapping')}) SELECT method, {columns}, count(*) AS n FROM x GROUP BY ALL"


def _made(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    return A.swap_pairs(pool, _next_pairs(pool), "obj", "obj_swapping")


@query(_augmented_sql("src || chr(9) || tgt AS value"))
def io_augmented_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_augmented(_made(spark, sf), path, "tsv")
    return spark.read.text(path).groupBy("method", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH x AS ({_swap_sql('obj', 'obj_swapping')}) SELECT row_number() OVER (ORDER BY method, draw, slot) - 1 AS pair_id, {strip_sql('src')} AS src, {strip_sql('tgt')} AS tgt FROM x")
def io_augmented_basic(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    sinks.write_augmented(materialise(_made(spark, sf)), path, "basic")
    return lines.read_aligned(spark, f"{path}/src", f"{path}/tgt")


def _blank_parser():  # noqa: ANN202
    """A parser that makes a chain of the words of each part between bars."""

    def parse(text: str) -> list[list[dict]]:
        parts = [p.split(" ") for p in text.split("|")]
        return [[{"id": i + 1, "form": w, "lemma": w.lower(), "upos": "X", "head": i, "deprel": "dep" if i else "root"} for i, w in enumerate(p)] for p in parts]

    return parse


@query("""WITH i AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE text || '|' || text END AS t FROM eval_item WHERE text IS NOT NULL),
p AS (SELECT item_id, len(string_split(t, '|')) AS n_sentences, string_split(t, ' ') AS ws FROM i)
SELECT item_id AS id, CAST(unnest(range(1, len(ws) + 1)) AS INTEGER) AS tok, unnest(ws) AS form FROM p WHERE n_sentences = 1""")
def parsed_items(spark: SparkSession, sf: str) -> DataFrame:
    """A registered parser; items of two sentences are left out by the one-sentence test."""
    dep_trees.register_parser("blank", _blank_parser)
    items = _t(spark, sf, "eval_item").where("text is not null").withColumn("t", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat_ws("|", "text", "text")))
    trees = L.one_sentence(dep_trees.parse(items, "item_id", "t", "blank"), "n_sentences")
    return trees.select("id", F.explode("tokens").alias("t")).select("id", F.col("t.id").alias("tok"), "t.form")


@query("SELECT pair_id, lang_hun AS code FROM hunglish_sampler WHERE lang_hun IS NOT NULL")
def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("__label__"), "lang_hun")
    return _h(spark, sf).where("lang_hun is not null").select("pair_id", T.iso_code(label).alias("code"))


@query(f"WITH {TOK} SELECT pair_id, side, id, form FROM tok WHERE upos = 'NOUN'")
def noun_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf).select("pair_id", "side", F.explode(R.with_property(F.col("tokens"), "upos", "NOUN")).alias("t"))
    return rows.select("pair_id", "side", "t.id", "t.form")


@query("SELECT lower(trim(domain)) AS run, CASE WHEN count(*) > 1000 THEN 'large' ELSE 'done' END AS state FROM hunglish_sampler WHERE domain IS NOT NULL GROUP BY 1 UNION ALL SELECT 'extra', 'new'")
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    """Run states: one replaced (twice), one added."""
    counts = _h(spark, sf).where("domain is not null").groupBy(T.folded_name(F.col("domain")).alias("run")).count()
    state = F.when(F.col("count") > 1000, "large").otherwise("done")
    rows = counts.select("run", state.alias("state"), F.lit(None).cast("string").alias("result"))
    return tables.upsert_status(tables.upsert_status(rows, "extra", "old"), "extra", "new").select("run", "state")


@query(f"{TREE} SELECT pair_id, dep AS pool FROM ok")
def incremental_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of the pairs with even numbers, then extended by all pairs."""
    pairs = materialise(L.tree_pairs(_trees(spark, sf)))
    even = pairs.where("pair_id % 2 = 0")
    first = L.candidate_pools(L.with_spans(even), separate=True).select("pair_id", "pool")
    return L.extend_pools(first, even, pairs, separate=True)


@query("""SELECT item_id, reverse(ref_text) AS src_translation, upper(text) AS tgt_translation, round(length(reverse(ref_text)) / length(text)::DOUBLE, 6) AS src_similarity,
 round(length(upper(text)) / length(ref_text)::DOUBLE, 6) AS tgt_similarity FROM eval_item""")
def round_trip_scores(spark: SparkSession, sf: str) -> DataFrame:
    """With stand-ins for the translators (reversed text, capitals) and the score (ratio of lengths)."""
    items = _t(spark, sf, "eval_item").select("item_id", F.col("text").alias("src"), F.col("ref_text").alias("tgt"))
    ratio = lambda a, b: F.round(F.length(b) / F.length(a), 6)
    return S.round_trip_scores(items, F.upper, F.reverse, ratio).drop("src", "tgt")


@query()
def corpus_meteor(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus_meteor(_t(spark, sf, "eval_item"), "ref_text", "text")


@query(f"""WITH {TOK}, e AS (SELECT t.pair_id, t.side, t.id, '  "' || replace(replace(coalesce(h.form || '_' || h.id, 'root_' || t.head), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" -> "' || replace(replace(t.form || '_' || t.id, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')
 || '" [label="' || replace(replace(coalesce(t.deprel, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"];' || chr(10) AS line FROM tok t LEFT JOIN tok h ON h.pair_id = t.pair_id AND h.side = t.side AND h.id = t.head)
SELECT pair_id, side, 'digraph {{' || chr(10) || string_agg(line, '' ORDER BY id) || '}}' AS dot FROM e GROUP BY 1, 2""")
def tree_drawings(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf).select("pair_id", "side", R.dot(F.col("tokens")).alias("dot"))


_CONFIG = {"data": {"src": "./a/x.hu", "files": ["../b", "c"]}, "steps": 10, "model": {"size": {"layers": 6}}}


@query("""SELECT * FROM (VALUES ('data.src', '"./a/x.hu"'), ('data.files', '["../b", "c"]'), ('steps', '10'), ('model.size.layers', '6')) AS v(key, value)""")
def flat_config(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in tables.flatten(_CONFIG).items()], "key string, value string")


@query("""SELECT * FROM (VALUES ('data.src', '".././a/x.hu"'), ('data.files', '["../../b", "c"]'), ('steps', '10'), ('model.size.layers', '6')) AS v(key, value)""")
def deeper_config(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in tables.flatten(tables.parent_paths(_CONFIG)).items()], "key string, value string")


@query("""SELECT * FROM (VALUES ('6', '10', NULL, 'd1', 'p1', 'g1', '31.5'), ('6', '10', '2', 'd2', 'p2', 'g2', '32.0')) AS v(layers, steps, extra, date, path, git_hash, bleu)""")
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """A history of two runs, the second with one more key, written and read again."""
    base = {"steps": 10, "model": {"size": {"layers": 6}}}
    one = tables.append_history(spark, None, base, {"bleu": 31.5}, "d1", "p1", "g1")
    two = tables.append_history(spark, one, base | {"extra": 2}, {"bleu": 32.0}, "d2", "p2", "g2")
    path = scratch_path(spark)
    two.coalesce(1).write.csv(path, sep="\t", header=True)
    return tables.read_history(spark, path).withColumnRenamed("model.size.layers", "layers")
