"""Queries of the operators on texts, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.encoding import restored_texts
from bitloom.llm.format_dedup import collapse_formats, format_duplicates
from bitloom.llm.group_split import assign_splits, broken_groups, split_checks
from bitloom.llm.language import fit_on, language_segments, wrong_labels
from bitloom.llm.leaks import find_leaks
from bitloom.llm.lexicon import COMMON
from bitloom.llm.mixing import mix_checks, mixed_corpus
from bitloom.llm.quality import non_prose, quality
from bitloom.llm.quota_sample import quota_sample, sample_sizes
from bitloom.llm.repetition import repeated_share
from bitloom.llm.split_overlap import overlap_pairs, overlap_report


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Words of the longest copied stretch that a document may have; a longer one flags it whatever the share.
LONGEST_REPEAT = 100
SIDES = {"hun": "hun", "eng": "eng"}
LABELLED = {"hun": ("hun", "lang_hun"), "eng": ("eng", "lang_eng")}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_restored(spark, sf).select("pair_id", "side")


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return restored_texts(_t(spark, sf, "hunglish_sampler"), "pair_id", SIDES).withColumnRenamed("id", "pair_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_pairs(_t(spark, sf, "hunglish_sampler"), "pair_id", "hun", "eng", "split").select("pair_id_a", "pair_id_b")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(_t(spark, sf, "hunglish_sampler"), "pair_id", "hun", "eng", "split", "source_file")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return non_prose(_t(spark, sf, "hunglish_sampler"), "pair_id", SIDES).select(F.col("id").alias("pair_id"), "side")


def p3_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality(_t(spark, sf, "hunglish_sampler"), "pair_id", SIDES).withColumnRenamed("id", "pair_id")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = p3_statistics(spark, sf)
    return rows.select("pair_id", "side", "n_chars", "n_words", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "common_share", "number_share")))


def p3_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quality(_t(spark, sf, "documents"), "doc_id", {"text": "text"}).withColumnRenamed("id", "doc_id").drop("side")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    records = _t(spark, sf, "hunglish_sampler")
    return wrong_labels(records, "pair_id", LABELLED, fit_on(records, "pair_id", LABELLED)).select(F.col("id").alias("pair_id"), "side", "lang")


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    records = _t(spark, sf, "hunglish_sampler")
    return language_segments(records, "pair_id", LABELLED, fit_on(records, "pair_id", LABELLED)).withColumnRenamed("id", "pair_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    twins = format_duplicates(_t(spark, sf, "hunglish_sampler"), "pair_id", "hun", "eng")
    return twins.select(F.col("rep").alias("pair_id_a"), F.col("id").alias("pair_id_b"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_formats(_t(spark, sf, "hunglish_sampler"), "pair_id", "hun", "eng").select("pair_id", "n_copies")


def _quotas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return quota_sample(_t(spark, sf, "hunglish_sampler"), "pair_id", "domain", _t(spark, sf, "domain_target"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf)[1].where("short").select("plan_id", "domain")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf)[1]


def p6_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf)[1].select("plan_id", "domain", "available", F.round("needed", 6).alias("needed"), "short")


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf)[0]


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sample_sizes(_t(spark, sf, "hunglish_sampler"), "pair_id", "domain", _t(spark, sf, "domain_target"))


def _split_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    return _t(spark, sf, "hunglish_sampler"), "pair_id", _t(spark, sf, "source_catalog"), _t(spark, sf, "split_target")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return broken_groups(*_split_tables(spark, sf)).select("group_id", "source_id")


def p7_splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(*_split_tables(spark, sf))


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    return split_checks(*_split_tables(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("n_exact > 0 and item_words >= 10").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p8_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("n_exact > 0 and item_words >= 10").select("doc_id", "item_id", "n_exact", "item_words")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    per = _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("covered_words").alias("most_words"))
    return _t(spark, sf, "eval_item").select("item_id", "suite").join(per, "item_id", "left")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_corpus(_t(spark, sf, "documents"), _t(spark, sf, "mix_target"))[1].where("short").select("mix_id", "source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_corpus(_t(spark, sf, "documents"), _t(spark, sf, "mix_target"))[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_corpus(_t(spark, sf, "documents"), _t(spark, sf, "mix_target"))[1]


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    return mix_checks(_t(spark, sf, "documents"), _t(spark, sf, "mix_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_share(_t(spark, sf, "documents"), "doc_id", "text").where("over_share").select(F.col("id").alias("doc_id"))


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_share(_t(spark, sf, "documents"), "doc_id", "text", max_longest=LONGEST_REPEAT).withColumnRenamed("id", "doc_id")


def p10_words(spark: SparkSession, sf: str) -> DataFrame:
    return p10_shares(spark, sf).select("doc_id", "n_words", "repeated_words", F.round("share", 6).alias("share"), "over_share")


_ALL = (
    p1_found, p1_restored, p2_found, p2_report, p3_found, p3_statistics, p3_counts, p3_documents, p4_found, p4_segments, p5_found,
    p5_collapsed, p6_found, p6_report, p6_targets, p6_sample, p6_sizes, p7_found, p7_splits, p7_kept, p8_found,
    p8_leaks, p8_exact, p8_items, p9_found, p9_mix, p9_report, p9_kept, p10_found, p10_shares, p10_words,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: The same results in SQL.
ORACLES: dict[str, str] = {
    "p2_found": r"""
WITH r AS (SELECT pair_id, split = 'train' AS tr,
    list_distinct(regexp_extract_all(lower(hun || ' ' || eng), '[\p{L}\p{N}]+')) AS ws
  FROM hunglish_sampler WHERE regexp_matches(hun, '\p{L}') AND regexp_matches(eng, '\p{L}')),
w AS (SELECT pair_id, tr, len(ws) AS n, unnest(ws) AS word FROM r),
c AS (SELECT a.pair_id AS x, b.pair_id AS y, a.n, b.n AS m, count(*) AS k
  FROM w a JOIN w b ON a.word = b.word AND a.tr AND NOT b.tr GROUP BY ALL)
SELECT least(x, y) AS pair_id_a, greatest(x, y) AS pair_id_b FROM c WHERE k * 10 >= (n + m - k) * 8
""",
    "p2_report": r"""
WITH r AS (SELECT pair_id, split = 'train' AS tr,
    list_distinct(regexp_extract_all(lower(hun || ' ' || eng), '[\p{L}\p{N}]+')) AS ws
  FROM hunglish_sampler WHERE regexp_matches(hun, '\p{L}') AND regexp_matches(eng, '\p{L}')),
w AS (SELECT pair_id, tr, len(ws) AS n, unnest(ws) AS word FROM r),
c AS (SELECT a.pair_id AS x, b.pair_id AS y, a.n, b.n AS m, count(*) AS k
  FROM w a JOIN w b ON a.word = b.word AND a.tr AND NOT b.tr GROUP BY ALL),
p AS (SELECT y AS pair_id, count(*) AS n FROM c WHERE k * 10 >= (n + m - k) * 8 GROUP BY 1)
SELECT split, source_file AS source, count(*) AS n_records, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM hunglish_sampler LEFT JOIN p USING (pair_id) WHERE split <> 'train' GROUP BY 1, 2
""",
    "p3_counts": r"""
WITH t AS (SELECT pair_id, 'hun' AS side, coalesce(hun, '') AS t FROM hunglish_sampler UNION ALL SELECT pair_id, 'eng', coalesce(eng, '') FROM hunglish_sampler),
w AS (SELECT pair_id, side, t, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws FROM t),
d AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS w FROM w) GROUP BY 1),
c AS (SELECT w FROM d WHERE n * 20 >= (SELECT count(*) FROM w WHERE len(ws) > 0) UNION SELECT unnest(string_split('""" + " ".join(sorted(COMMON)) + r"""', ' '))),
k AS (SELECT pair_id, side, count(c.w) AS common, sum(length(x)) AS letters, count(*) FILTER (regexp_matches(x, '[0-9]')) AS numbers FROM (SELECT pair_id, side, unnest(ws) AS x FROM w) LEFT JOIN c ON c.w = x GROUP BY 1, 2)
SELECT pair_id, side, length(t) AS n_chars, len(ws) AS n_words, round(coalesce(letters, 0) / greatest(len(ws), 1)::DOUBLE, 6) AS mean_word_length,
 round(coalesce(common, 0) / greatest(len(ws), 1)::DOUBLE, 6) AS common_share, round(coalesce(numbers, 0) / greatest(len(ws), 1)::DOUBLE, 6) AS number_share
FROM w LEFT JOIN k USING (pair_id, side)
""",
    "p5_found": r"""
WITH r AS (SELECT pair_id, regexp_replace(lower(hun), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(eng), '[^\p{L}\p{N}]', '', 'g') AS b
  FROM hunglish_sampler WHERE regexp_matches(hun, '\p{L}') AND regexp_matches(eng, '\p{L}')),
g AS (SELECT pair_id, min(pair_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM r)
SELECT first_id AS pair_id_a, pair_id AS pair_id_b FROM g WHERE first_id <> pair_id
""",
    "p5_collapsed": r"""
WITH r AS (SELECT pair_id, regexp_replace(lower(hun), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(eng), '[^\p{L}\p{N}]', '', 'g') AS b
  FROM hunglish_sampler WHERE regexp_matches(hun, '\p{L}') AND regexp_matches(eng, '\p{L}')),
g AS (SELECT pair_id, min(pair_id) OVER w AS first_id, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY least(a, b), greatest(a, b)))
SELECT pair_id, n AS n_copies FROM g WHERE pair_id = first_id
UNION ALL SELECT pair_id, 1 FROM hunglish_sampler ANTI JOIN r USING (pair_id)
""",
    "p6_found": r"""
WITH d AS (SELECT lower(trim(domain)) AS domain, count(*) AS n FROM hunglish_sampler WHERE domain IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM d)
SELECT plan_id, p.domain FROM domain_target p CROSS JOIN t LEFT JOIN d ON d.domain = lower(trim(p.domain))
WHERE coalesce(d.n, 0) < greatest(min_rows, target_share * sample_share * total)
""",
    "p6_targets": r"""
WITH d AS (SELECT lower(trim(domain)) AS domain, count(*) AS n FROM hunglish_sampler WHERE domain IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM d),
x AS (SELECT plan_id, p.domain, coalesce(d.n, 0) AS available, greatest(min_rows, target_share * sample_share * total) AS needed
  FROM domain_target p CROSS JOIN t LEFT JOIN d ON d.domain = lower(trim(p.domain)))
SELECT plan_id, domain, available, round(needed, 6) AS needed, available < needed AS short FROM x
""",
    "p6_sizes": r"""
WITH d AS (SELECT lower(trim(domain)) AS domain, count(*) AS n FROM hunglish_sampler WHERE domain IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM d),
x AS (SELECT plan_id, min_rows, sample_share * total AS size, coalesce(d.n, 0) AS available FROM domain_target p CROSS JOIN t LEFT JOIN d ON d.domain = lower(trim(p.domain))),
n AS (SELECT plan_id, CAST(greatest(sum(least(min_rows, available)), least(floor(max(size) + 0.5), sum(available))) AS BIGINT) AS n FROM x GROUP BY 1)
SELECT plan_id, n AS n_rows, n AS n_ids, true AS floors_kept FROM n
""",
    "p7_found": r"""
WITH RECURSIVE names AS (
  SELECT DISTINCT source_id, k || lower(trim(v)) AS name FROM (
    SELECT source_id, 'a' AS k, author AS v FROM source_catalog UNION ALL SELECT source_id, 's', series FROM source_catalog)
  WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'unknown', 'n/a', '-', 'ismeretlen', 'various')),
pairs AS (SELECT DISTINCT x.source_id AS a, y.source_id AS b FROM names x JOIN names y USING (name)
  UNION SELECT source_id, source_id FROM source_catalog),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
grp AS (SELECT a AS source_id, min(b) AS group_id FROM reach GROUP BY a),
src AS (SELECT DISTINCT source_id, lower(trim(source_file)) AS f, lower(trim(domain)) AS d FROM source_catalog),
rec AS (SELECT DISTINCT lower(trim(domain)) AS d, regexp_replace(lower(trim(source_file)), '^.*[/\\]', '') AS f, split FROM hunglish_sampler),
used AS (SELECT DISTINCT group_id, source_id, split FROM rec JOIN src USING (f, d) JOIN grp USING (source_id)),
bad AS (SELECT group_id FROM used GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT DISTINCT group_id, source_id FROM used SEMI JOIN bad USING (group_id)
""",
    "p7_kept": "SELECT count(*) AS n_records, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_divided FROM hunglish_sampler",
    "p8_found": r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_item WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM iw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p8_exact": r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_item WHERE text IS NOT NULL),
ig AS (SELECT item_id, i, len(ws) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM iw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM dw))
SELECT doc_id, item_id, count(DISTINCT i) AS n_exact, max(n) AS item_words FROM dg JOIN ig USING (g) GROUP BY 1, 2
""",
    "p9_found": r"""
WITH s AS (SELECT source, sum(length(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM s)
SELECT mix_id, m.source FROM mix_target m CROSS JOIN t LEFT JOIN s ON s.source = m.source
WHERE coalesce(s.n, 0) * max_repeats < weight * budget_share * total
""",
    "p9_kept": "SELECT DISTINCT mix_id, source, true AS within_budget, true AS near_budget, true AS repeats_kept FROM mix_target",
    "p10_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS p FROM r)
SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) * 10 > 3 * n
""",
    "p10_words": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS p FROM r),
k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT t.doc_id, coalesce(len(d.ws), 0) AS n_words, coalesce(k.n, 0) AS repeated_words, round(coalesce(k.n, 0) / greatest(coalesce(len(d.ws), 0), 1)::DOUBLE, 6) AS share,
 coalesce(k.n, 0) * 10 > 3 * coalesce(len(d.ws), 0) AS over_share FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}
