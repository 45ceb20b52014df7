"""Queries of the general operators over the test tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions import trees as R
from bitloom.operators import augment as A
from bitloom.operators import filters as L
from bitloom.operators import joins as J
from bitloom.operators import near_duplicates as N
from bitloom.operators import reports as P
from bitloom.operators import sampling as M
from bitloom.operators import scoring as S
from bitloom.operators import stats as D
from bitloom.operators.tree_similarity import jaccard_from_sizes
from bitloom.scratch import materialise
from bitloom.sources.dep_trees import to_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _h(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "hunglish_sampler")


def _r(c, name: str):  # noqa: ANN001, ANN202
    return F.round(c, 6).alias(name)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    s = strip_sql(x)
    return f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '{T.WS}+')) END AS INTEGER)"


def blanks_sql(x: str) -> str:
    return f"CAST(len(string_split({x}, ' ')) AS INTEGER)"


def md5_sql(*parts: str, seed: int = SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(parts)}))"


def int_sql(*parts: str, seed: int = SEED) -> str:
    return f"CAST('0x' || substr({md5_sql(*parts, seed=seed)}, 1, 8) AS BIGINT)"


# ---- text ----

@query(f"SELECT pair_id, {words_sql('hun')} AS hun_words, {words_sql('eng')} AS eng_words, CAST(length(hun) AS INTEGER) AS hun_chars, CAST(length(eng) AS INTEGER) AS eng_chars, abs({words_sql('hun')} - {words_sql('eng')}) AS word_difference, CAST(abs(length(hun) - length(eng)) AS INTEGER) AS char_difference, round({words_sql('hun')} / nullif({words_sql('eng')}, 0)::DOUBLE, 6) AS word_ratio FROM hunglish_sampler")
def word_stats(spark: SparkSession, sf: str) -> DataFrame:
    a, b = T.word_count(F.col("hun")), T.word_count(F.col("eng"))
    return _h(spark, sf).select("pair_id", a.alias("hun_words"), b.alias("eng_words"), F.length("hun").alias("hun_chars"), F.length("eng").alias("eng_chars"), F.abs(a - b).alias("word_difference"), F.abs(F.length("hun") - F.length("eng")).alias("char_difference"), _r(T.length_ratio(a, b), "word_ratio"))


@query(f"SELECT pair_id, {blanks_sql('hun')} AS parts, round((length(hun) - {blanks_sql('hun')}) / {blanks_sql('hun')}::DOUBLE, 6) AS average_length, round(len(regexp_extract_all(hun, '[A-Z]')) / nullif(length(hun), 0)::DOUBLE, 6) AS capitals, regexp_matches(hun, '\\p{{L}}') AS letters FROM hunglish_sampler")
def char_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("hun")
    return _h(spark, sf).select("pair_id", T.blank_count(c).alias("parts"), _r(T.average_word_length(c), "average_length"), _r(T.uppercase_ratio(c), "capitals"), T.has_letters(c).alias("letters"))


def _good_length_sql(most: str) -> str:
    return f"""WITH w AS (SELECT pair_id, {words_sql('hun')} AS a, {words_sql('eng')} AS b FROM hunglish_sampler)
SELECT pair_id FROM w WHERE a > 0 AND b > 0 AND a {most} AND b {most} AND (abs(a - b) < 7 OR (a / b::DOUBLE < 1.2 AND b / a::DOUBLE < 1.2))"""


@query(_good_length_sql("< 32"))
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.filter_by_length(_h(spark, sf), "hun", "eng").select("pair_id")


@query(_good_length_sql("<= 16"))
def length_filter_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    return L.filter_by_length(_h(spark, sf), "hun", "eng", most=16, inclusive_max=True).select("pair_id")


@query(f"""WITH w AS (SELECT pair_id, {blanks_sql('hun')} AS a, {blanks_sql('eng')} AS b FROM hunglish_sampler)
SELECT pair_id FROM w WHERE a < 32 AND b < 32 AND (abs(a - b) < 8 OR a / b::DOUBLE BETWEEN 0.5 AND 2)""")
def blank_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.blank_length_filter(_h(spark, sf), "hun", "eng").select("pair_id")


@query(f"SELECT pair_id FROM hunglish_sampler WHERE (length(hun) - {blanks_sql('hun')}) / {blanks_sql('hun')}::DOUBLE BETWEEN 2 AND 10")
def word_length_band(spark: SparkSession, sf: str) -> DataFrame:
    return L.word_length_band(_h(spark, sf), "hun").select("pair_id")


@query("SELECT pair_id FROM hunglish_sampler WHERE len(regexp_extract_all(hun, '[A-Z]')) / nullif(length(hun), 0)::DOUBLE < 0.15 AND len(regexp_extract_all(eng, '[A-Z]')) / nullif(length(eng), 0)::DOUBLE < 0.15")
def uppercase_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.few_capitals(_h(spark, sf), "hun", "eng").select("pair_id")


_FORBIDDEN = T.FORBIDDEN.replace("'", "''")


def _fixed_sql(x: str) -> str:
    s = f"translate({strip_sql(x)}, '{T.LOOKALIKES[0]}', '{T.LOOKALIKES[1]}')"
    return f"CASE WHEN regexp_matches({s}, '^{_FORBIDDEN}') THEN substr({s}, 2) ELSE {s} END"


@query(f"""WITH f AS (SELECT pair_id, {_fixed_sql('hun')} AS hun, {_fixed_sql('eng')} AS eng FROM hunglish_sampler)
SELECT pair_id, hun, eng FROM f WHERE NOT regexp_matches(hun, '{_FORBIDDEN}') AND NOT regexp_matches(eng, '{_FORBIDDEN}')""")
def clean_characters(spark: SparkSession, sf: str) -> DataFrame:
    return L.clean_characters(_h(spark, sf), "hun", "eng").select("pair_id", "hun", "eng")


@query(f"SELECT character, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(hun, '{_FORBIDDEN}')) AS character FROM hunglish_sampler) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def forbidden_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return D.forbidden_histogram(_h(spark, sf), "hun")


@query(f"""SELECT pair_id, translate(hun, '{T.LOOKALIKES[0]}', '{T.LOOKALIKES[1]}') AS lookalikes, regexp_replace(hun, '"|- |''', '', 'g') AS marks, replace(eng, '"', '') AS eng_quotes,
 regexp_replace(regexp_replace(hun, '^-+', ''), '^{T.WS}+', '') AS hun_dash, {strip_sql('hun')} AS stripped FROM hunglish_sampler""")
def text_projections(spark: SparkSession, sf: str) -> DataFrame:
    h, e = F.col("hun"), F.col("eng")
    return _h(spark, sf).select("pair_id", T.fix_lookalikes(h).alias("lookalikes"), T.remove_marks(h).alias("marks"), T.remove_eng_quotes(e).alias("eng_quotes"), T.remove_hun_dash(h).alias("hun_dash"), T.strip_all(h).alias("stripped"))


def _punctuation_sql(x: str, language: str) -> str:
    for pattern, by in (*T.PUNCTUATION, *T.BY_LANGUAGE.get(language, T.OTHER_LANGUAGES)):
        p, b = pattern.replace("'", "''"), by.replace("$", "\\").replace("'", "''")
        x = f"regexp_replace({x}, '{p}', '{b}', 'g')"
    return x


@query(f"SELECT pair_id, {_punctuation_sql('hun', 'hu')} AS hun, {_punctuation_sql('eng', 'en')} AS eng FROM hunglish_sampler")
def punctuation(spark: SparkSession, sf: str) -> DataFrame:
    return _h(spark, sf).select("pair_id", T.normalise_punctuation(F.col("hun"), "hu").alias("hun"), T.normalise_punctuation(F.col("eng"), "en").alias("eng"))


@query()
def clean_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _h(spark, sf).select("pair_id", T.clean_sentence(F.col("hun")).alias("hun"), T.clean_sentence(F.col("eng")).alias("eng"))


@query(r"""SELECT pair_id, array_to_string(list_filter(string_split_regex(trim(lower(regexp_replace(eng, '[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g'))), '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda x: x <> ''), ' ') AS shingle_words,
 array_to_string(list_filter(string_split_regex(regexp_replace(eng, '[^\p{L}\p{N}_]', ' ', 'g'), ' +'), lambda x: x <> ''), ' ') AS vector_words FROM hunglish_sampler WHERE eng IS NOT NULL""")
def prepared_words(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("eng")
    return _h(spark, sf).where("eng is not null").select("pair_id", F.array_join(T.shingle_words(e), " ").alias("shingle_words"), F.array_join(T.vector_words(e), " ").alias("vector_words"))


@query("SELECT pair_id FROM hunglish_sampler WHERE lang_hun = 'hu' AND lang_eng = 'en'")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.correct_language(_h(spark, sf), "lang_hun", "lang_eng", "hu", "en").select("pair_id")


@query("SELECT pair_id FROM hunglish_sampler WHERE length(hun) > 0 AND length(eng) > 0 AND NOT contains(hun, '�') AND NOT contains(eng, '�')")
def literal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.without_text(L.non_empty(_h(spark, sf), "hun", "eng"), ["hun", "eng"], "�").select("pair_id")


# ---- rows: copies, joins, sets ----

@query("SELECT hun, eng, count(*) AS copies FROM hunglish_sampler GROUP BY 1, 2")
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_counts(_h(spark, sf), ["hun", "eng"])


@query("SELECT DISTINCT hun, eng FROM hunglish_sampler")
def exact_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _h(spark, sf).select("hun", "eng").distinct()


def _split(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _h(spark, sf).where(F.col("split") == name)


@query("SELECT pair_id FROM hunglish_sampler a WHERE split = 'train' AND EXISTS (SELECT 1 FROM hunglish_sampler b WHERE b.split = 'test' AND a.hun = b.hun AND a.eng = b.eng)")
def overlap_with_test(spark: SparkSession, sf: str) -> DataFrame:
    return J.overlap(_split(spark, sf, "train"), _split(spark, sf, "test"), ["hun", "eng"]).select("pair_id")


@query("SELECT a.pair_id FROM hunglish_sampler a JOIN hunglish_sampler b ON a.hun = b.hun AND a.eng = b.eng WHERE a.split = 'train' AND b.split = 'valid'")
def overlap_multiplied(spark: SparkSession, sf: str) -> DataFrame:
    return J.overlap(_split(spark, sf, "train"), _split(spark, sf, "valid"), ["hun", "eng"], keep_multiplicity=True).select("pair_id")


@query("SELECT pair_id FROM hunglish_sampler a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM hunglish_sampler b WHERE b.split <> 'train' AND a.hun = b.hun AND a.eng = b.eng)")
def train_without_overlap(spark: SparkSession, sf: str) -> DataFrame:
    held = _h(spark, sf).where("split <> 'train'")
    return J.without_overlap(_split(spark, sf, "train"), held, ["hun", "eng"]).select("pair_id")


@query("""SELECT hun AS line, 'hun' AS side FROM hunglish_sampler WHERE split = 'test' UNION ALL SELECT eng, 'eng' FROM hunglish_sampler WHERE split = 'test'""")
def union_sides(spark: SparkSession, sf: str) -> DataFrame:
    test = _split(spark, sf, "test")
    return test.select(F.col("hun").alias("line"), F.lit("hun").alias("side")).unionByName(test.select(F.col("eng").alias("line"), F.lit("eng").alias("side")))


@query("""SELECT pair_id FROM sentence_stats WHERE hu_cons EXCEPT SELECT pair_id FROM sentence_stats WHERE hu_nsubj > 1 EXCEPT SELECT pair_id FROM sentence_stats WHERE hu_obj > 1""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "sentence_stats")
    return s.where("hu_cons").select("pair_id").subtract(s.where("hu_nsubj > 1").select("pair_id")).subtract(s.where("hu_obj > 1").select("pair_id"))


@query("SELECT pair_id, line_no, CAST(floor(line_no / 100.0) AS BIGINT) AS batch FROM hunglish_sampler WHERE floor(line_no / 100.0) >= 2")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return M.batches(_h(spark, sf).select("pair_id", "line_no"), "line_no", 100, skip=2)


@query("SELECT item_id, CAST(floor(((item_id - 1001) / 3) / 35.0) AS BIGINT) AS mini_batch FROM eval_item")
def mini_batches(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "eval_item").select("item_id", ((F.col("item_id") - 1001) / 3).alias("_i"))
    return M.mini_batches(items, "_i", 7, 240).select("item_id", "mini_batch")


@query(f"""WITH s AS (SELECT pair_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {md5_sql("'split'", 'CAST(pair_id AS VARCHAR)')}, pair_id) AS r FROM hunglish_sampler)
SELECT pair_id, CASE WHEN r <= 20 THEN 'test' WHEN r <= 50 THEN 'valid' ELSE 'train' END AS new_split FROM s""")
def split_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_by_group(_h(spark, sf).select("pair_id", "domain"), "domain", "pair_id", 20, 30, SEED).select("pair_id", "new_split")


@query(f"SELECT pair_id, CASE WHEN {int_sql(chr(39) + 'share' + chr(39), 'CAST(pair_id AS VARCHAR)')} / 4294967296.0::DOUBLE < 0.15 THEN 'valid' ELSE 'train' END AS new_split FROM hunglish_sampler")
def split_by_share(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_by_share(_h(spark, sf).select("pair_id"), "pair_id", 0.15, SEED)


@query(f"""WITH w AS (SELECT pair_id, CAST(floor({words_sql('hun')} / 10.0) AS BIGINT) AS bucket FROM hunglish_sampler WHERE hun IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {md5_sql("'sample'", 'CAST(pair_id AS VARCHAR)')}, pair_id) AS r FROM w)
SELECT pair_id, bucket FROM s WHERE r <= 20""")
def sample_by_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = _h(spark, sf).where("hun is not null").select("pair_id", F.floor(T.word_count(F.col("hun")) / 10).alias("bucket"))
    return M.sample_per_group(rows, ["bucket"], "pair_id", 20, SEED)


@query(f"""WITH u AS (SELECT pair_id, {int_sql("'again'", 'CAST(pair_id AS VARCHAR)')} / 4294967296.0::DOUBLE AS u FROM hunglish_sampler),
n AS (SELECT pair_id, len(list_filter({M.poisson_steps(0.5)}::DOUBLE[], lambda s: s <= u)) AS n FROM u) SELECT pair_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n WHERE n > 0""")
def sample_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    return M.sample_with_replacement(_h(spark, sf).select("pair_id"), "pair_id", 0.5, SEED)


# ---- statistics ----

@query("SELECT domain, count(*) AS n, round(count(*) / (SELECT count(*) FROM hunglish_sampler)::DOUBLE, 6) AS share FROM hunglish_sampler GROUP BY 1")
def domain_shares(spark: SparkSession, sf: str) -> DataFrame:
    return D.shares(_h(spark, sf), "domain").withColumn("share", F.round("share", 6))


def _describe_sql(table: str, column: str, x: str) -> str:
    q = ", ".join(f"round(quantile_cont(x, {p}), 6) AS q{round(p * 1000)}" for p in D.QUANTILES)
    return f"SELECT '{column}' AS column_name, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std_sample, round(stddev_pop(x), 6) AS std_population, min(x) AS lowest, max(x) AS highest, {q} FROM (SELECT CAST({x} AS DOUBLE) AS x FROM {table})"


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*(F.round(c, 6).alias(c) if t == "double" and c not in ("lowest", "highest") else c for c, t in d.dtypes))


@query(" UNION ALL ".join(_describe_sql("hunglish_sampler", f"{s}_words", words_sql(s)) for s in ("hun", "eng")))
def describe_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = _h(spark, sf).select(T.word_count(F.col("hun")).alias("hun_words"), T.word_count(F.col("eng")).alias("eng_words"))
    return _rounded(D.describe(rows, ["hun_words", "eng_words"]))


@query(" UNION ALL ".join(_describe_sql("sentence_stats", c, c) for c in ("hu_nsubj", "en_obj", "hu_len", "en_len")))
def describe_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.describe(_t(spark, sf, "sentence_stats"), ["hu_nsubj", "en_obj", "hu_len", "en_len"]))


def _ngram_sql(n: int) -> str:
    return f"""WITH w AS (SELECT regexp_split_to_array({strip_sql('lower(hun)')}, '{T.WS}+') AS w FROM hunglish_sampler WHERE hun IS NOT NULL),
g AS (SELECT array_to_string(w[i:i + {n - 1}], ' ') AS ngram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE w[1] <> '' AND len(w) >= {n}))
SELECT ngram, {n} AS n, count(*) AS cnt FROM g GROUP BY 1 ORDER BY cnt DESC, ngram LIMIT 100"""


def _ngrams(n: int) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return D.ngram_counts(_h(spark, sf), "hun", n).orderBy(F.desc("cnt"), "ngram").limit(100)

    f.__name__ = f"ngram{n}_top"
    return query(_ngram_sql(n))(f)


ngram1_top, ngram2_top, ngram3_top = (_ngrams(n) for n in (1, 2, 3))


@query("SELECT count(*) FILTER (NOT hu_cons) AS hu_gaps, count(*) FILTER (NOT en_cons) AS en_gaps, count(*) FILTER (en_nsubj < hu_nsubj) AS fewer_subjects, count(*) FILTER (hu_obj = 1 AND en_obj = 1 AND hu_cons AND en_cons) AS swappable FROM sentence_stats")
def condition_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return D.conditional_counts(_t(spark, sf, "sentence_stats"), {"hu_gaps": ~c("hu_cons"), "en_gaps": ~c("en_cons"), "fewer_subjects": c("en_nsubj") < c("hu_nsubj"), "swappable": (c("hu_obj") == 1) & (c("en_obj") == 1) & c("hu_cons") & c("en_cons")})


_RATIOS, _CUTOFFS = [1.1, 1.2, 1.3, 1.5, 1.75, 2.0], [0, 4, 7, 10]


@query(f"""WITH w AS (SELECT {words_sql('hun')} AS a, {words_sql('eng')} AS b FROM hunglish_sampler WHERE hun IS NOT NULL AND eng IS NOT NULL),
g AS (SELECT r.r AS ratio, c.c AS cutoff FROM (SELECT unnest({_RATIOS})::DOUBLE AS r) r, (SELECT unnest({_CUTOFFS})::INTEGER AS c) c)
SELECT ratio, cutoff, round(avg(CASE WHEN abs(a - b) < cutoff OR (a > 0 AND b > 0 AND greatest(a / b::DOUBLE, b / a::DOUBLE) < ratio) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS kept FROM w, g GROUP BY 1, 2""")
def length_sweep(spark: SparkSession, sf: str) -> DataFrame:
    h = _h(spark, sf)
    w = h.select(T.word_count(F.col("hun")).alias("a"), T.word_count(F.col("eng")).alias("b"))
    return D.sweep(w, F.col("a"), F.col("b"), _RATIOS, _CUTOFFS).withColumn("kept", F.round("kept", 6))


@query("""WITH l AS (SELECT min(jaccard) AS lo, max(jaccard) AS hi FROM edge_similarity)
SELECT CAST(least(5, greatest(1, ceil((jaccard - lo) * 5 / (hi - lo)))) AS INTEGER) AS bin, count(*) AS n FROM edge_similarity, l WHERE jaccard IS NOT NULL GROUP BY 1""")
def similarity_bins(spark: SparkSession, sf: str) -> DataFrame:
    return D.equal_width_bins(_t(spark, sf, "edge_similarity"), "jaccard", 5)


_CORR = ["src_size", "tgt_size", "common", "jaccard"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM edge_similarity" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def similarity_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return D.correlations(_t(spark, sf, "edge_similarity"), _CORR).withColumn("r", F.round("r", 6))


@query("SELECT src_idx, tgt_idx, round(common / nullif(src_size - 1 + tgt_size - 1 - common, 0)::DOUBLE, 4) AS value, round(jaccard, 4) AS given FROM edge_similarity")
def jaccard_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "edge_similarity").select("src_idx", "tgt_idx", F.round(jaccard_from_sizes(F.col("common"), F.col("src_size"), F.col("tgt_size")), 4).alias("value"), F.round("jaccard", 4).alias("given"))


@query("""WITH s AS (SELECT src_idx, tgt_idx, src_size % 4 AS grp, jaccard, common FROM edge_similarity),
q AS (SELECT grp, quantile_cont(jaccard, 0.4) AS a, quantile_cont(common, 0.4) AS b FROM s GROUP BY 1)
SELECT src_idx, tgt_idx, s.grp FROM s JOIN q USING (grp) WHERE jaccard > a AND common > b""")
def quantile_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "edge_similarity").select("src_idx", "tgt_idx", (F.col("src_size") % 4).alias("grp"), "jaccard", "common")
    return L.above_quantile(rows, "grp", "jaccard", "common", 0.4).select("src_idx", "tgt_idx", "grp")


@query("""WITH q AS (SELECT quantile_cont(jaccard, 0.2) AS a, quantile_cont(jaccard, 0.8) AS b, quantile_cont(common, 0.2) AS c, quantile_cont(common, 0.8) AS d FROM edge_similarity)
SELECT src_idx, tgt_idx FROM edge_similarity, q WHERE jaccard > a AND jaccard < b AND common > c AND common < d""")
def quantile_band(spark: SparkSession, sf: str) -> DataFrame:
    return L.between_quantiles(_t(spark, sf, "edge_similarity"), "jaccard", "common", 0.2, 0.8).select("src_idx", "tgt_idx")


@query("""SELECT event_id, round(value - last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS difference FROM events""")
def baseline_difference(spark: SparkSession, sf: str) -> DataFrame:
    return D.baseline_difference(_t(spark, sf, "events"), "user_id", "event_id", "event_type", "view", "value").select("event_id", F.round("difference", 6).alias("difference"))


# ---- trees ----

TOK = r"""tok AS (SELECT DISTINCT pair_id, side, CAST(regexp_extract(target_key, '_(\d+)$', 1) AS INTEGER) AS id, regexp_extract(target_key, '^(.*)_(\d+)$', 1) AS form,
 nullif(nullif(trim(target_lemma), 'None'), '') AS lemma, nullif(nullif(target_postag, 'None'), '') AS upos, coalesce(TRY_CAST(regexp_extract(source_key, '_(\d+)$', 1) AS INTEGER), 0) AS head, target_deprel AS deprel
 FROM dep_edge WHERE regexp_matches(target_key, '_\d+$'))"""
ANC = """anc AS (SELECT pair_id, side, id, id AS a, 0 AS n FROM tok UNION ALL
 SELECT x.pair_id, x.side, x.id, coalesce(t.head, 0), x.n + 1 FROM anc x LEFT JOIN tok t ON t.pair_id = x.pair_id AND t.side = x.side AND t.id = x.a WHERE x.a <> 0)"""


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    return R.trees_from_edges(_t(spark, sf, "dep_edge"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_spans(L.tree_pairs(_trees(spark, sf)))


@query(f"WITH {TOK} SELECT pair_id, side, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) FILTER (upos IS DISTINCT FROM 'PUNCT') AS INTEGER) AS n_words, string_agg(form, ' ' ORDER BY id) AS text FROM tok GROUP BY 1, 2")
def tree_sentences(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    return _trees(spark, sf).select("pair_id", "side", F.size(t).alias("n_tokens"), R.words_without_punctuation(t).alias("n_words"), R.sentence(t).alias("text"))


@query(f"WITH {TOK}, r AS (SELECT pair_id, side, min(id) AS id FROM tok WHERE lower(deprel) = 'root' GROUP BY 1, 2) SELECT pair_id, side, id, form, upos FROM r JOIN tok USING (pair_id, side, id)")
def root_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf).select("pair_id", "side", R.root_token(F.col("tokens")).alias("r")).where("r is not null")
    return rows.select("pair_id", "side", "r.id", "r.form", "r.upos")


@query(f"WITH RECURSIVE {TOK}, {ANC} SELECT pair_id, side, id, CAST(max(n) AS INTEGER) AS depth FROM anc WHERE a = 0 GROUP BY 1, 2, 3")
def node_depths(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    rows = _trees(spark, sf).select("pair_id", "side", F.explode(F.arrays_zip(F.transform(t, lambda x: x["id"]).alias("id"), R.depths(t).alias("depth"))).alias("x"))
    return rows.select("pair_id", "side", "x.id", "x.depth")


@query(f"WITH {TOK} SELECT CASE WHEN contains(deprel, ':') THEN lower(split_part(deprel, ':', 1)) ELSE lower(deprel) END AS label, count(*) AS n FROM tok GROUP BY 1")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.label_counts(_trees(spark, sf))


@query(f"""WITH {TOK}, c AS (SELECT side, lower(split_part(deprel, ':', 1)) AS label, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT label, coalesce(sum(n) FILTER (side = 'hun'), 0)::BIGINT AS hun, coalesce(sum(n) FILTER (side = 'eng'), 0)::BIGINT AS eng FROM c WHERE label NOT IN ('punct', 'root') GROUP BY 1""")
def labels_by_side(spark: SparkSession, sf: str) -> DataFrame:
    trees = _trees(spark, sf)
    one = lambda side: R.label_counts(trees.where(F.col("side") == side)).withColumnRenamed("n", side)
    return J.outer_counts(one("hun"), one("eng"), "label").where("label not in ('punct', 'root')")


@query(f"""WITH {TOK} SELECT t.pair_id, t.side, t.id AS tok_no, t.form || '_' || t.id AS target_key, CASE WHEN t.head = 0 THEN 'root_0' ELSE coalesce(h.form || '_', '') || t.head END AS source_key, h.upos AS source_postag, h.lemma AS source_lemma
FROM tok t LEFT JOIN tok h ON h.pair_id = t.pair_id AND h.side = t.side AND h.id = t.head""")
def dep_edges_long(spark: SparkSession, sf: str) -> DataFrame:
    return to_edges(_trees(spark, sf), "pair_id", "side").select("pair_id", "side", "tok_no", "target_key", "source_key", "source_postag", "source_lemma")


@query(f"""WITH {TOK} SELECT pair_id, side, CAST(sum(CASE WHEN deprel IN ('nmod', 'obl', 'case', 'amod', 'advmod') THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM tok GROUP BY 1, 2""")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _trees(spark, sf).select("pair_id", "side", F.explode("tokens").alias("t")).groupBy("pair_id", "side").agg(F.sum(R.edge_weight(F.col("t.deprel"))).alias("weight"))


@query(f"WITH {TOK} SELECT a.pair_id, a.id, a.form AS hun_form, b.form AS eng_form FROM tok a JOIN tok b ON a.pair_id = b.pair_id AND a.id = b.id WHERE a.side = 'hun' AND b.side = 'eng'")
def zipped_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf).select("pair_id", "side", F.explode("tokens").alias("t")).select("pair_id", "side", "t.id", "t.form")
    one = lambda s: rows.where(F.col("side") == s).select("pair_id", "id", F.col("form").alias(f"{s}_form"))
    return J.zip_join(one("hun"), one("eng"), ["pair_id", "id"])


# one row for each pair, side and dependency with exactly one edge: head token, subtree
SUB = """both_sides AS (SELECT pair_id FROM tok GROUP BY 1 HAVING count(DISTINCT side) = 2),
one AS (SELECT pair_id, side, deprel AS dep, min(id) AS id FROM tok SEMI JOIN both_sides USING (pair_id) WHERE deprel IN ('obj', 'nsubj') GROUP BY 1, 2, 3 HAVING count(*) = 1),
sub AS (SELECT o.pair_id, o.side, o.dep, o.id, CAST(min(x.id) AS INTEGER) AS lo, CAST(max(x.id) AS INTEGER) AS hi, count(DISTINCT x.id) AS n FROM one o JOIN anc x ON x.pair_id = o.pair_id AND x.side = o.side AND x.a = o.id GROUP BY 1, 2, 3, 4),
info AS (SELECT s.*, t.upos, t.head FROM sub s JOIN tok t ON t.pair_id = s.pair_id AND t.side = s.side AND t.id = s.id),
ok AS (SELECT h.pair_id, h.dep, h.lo AS slo, h.hi AS shi, e.lo AS tlo, e.hi AS thi, h.head AS shead, e.head AS thead FROM info h JOIN info e ON h.pair_id = e.pair_id AND h.dep = e.dep
 WHERE h.side = 'hun' AND e.side = 'eng' AND h.hi - h.lo + 1 = h.n AND e.hi - e.lo + 1 = e.n AND h.upos IS NOT DISTINCT FROM e.upos),
pool2 AS (SELECT o.pair_id FROM ok o JOIN ok n USING (pair_id) WHERE o.dep = 'obj' AND n.dep = 'nsubj' AND o.shead = n.shead AND o.thead = n.thead)"""
TREE = f"WITH RECURSIVE {TOK}, {ANC}, {SUB}"


@query(f"{TREE} SELECT pair_id, dep, side, lo, hi, CAST(n AS INTEGER) AS n FROM sub")
def subtree_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf)
    cells = [F.struct(F.lit(d).alias("dep"), F.lit(n).alias("side"), F.col(f"{s}_{d}_ids").alias("ids")) for d in ("obj", "nsubj") for s, n in (("src", "hun"), ("tgt", "eng"))]
    return rows.select("pair_id", F.inline(F.array(*cells))).where("ids is not null").select("pair_id", "dep", "side", F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"), F.size("ids").alias("n"))


@query(f"{TREE} SELECT pair_id, dep AS pool FROM ok")
def separate_pools(spark: SparkSession, sf: str) -> DataFrame:
    return L.candidate_pools(_pairs(spark, sf), separate=True).select("pair_id", "pool")


@query(f"{TREE} SELECT pair_id, 'both' AS pool FROM pool2")
def shared_pool(spark: SparkSession, sf: str) -> DataFrame:
    return L.candidate_pools(_pairs(spark, sf)).select("pair_id", "pool")


@query(f"""{TREE}, nouns AS (SELECT o.pair_id, o.dep, o.side FROM one o JOIN anc x ON x.pair_id = o.pair_id AND x.side = o.side AND x.a = o.id JOIN tok t ON t.pair_id = x.pair_id AND t.side = x.side AND t.id = x.id WHERE t.upos IN ('NOUN', 'PROPN') GROUP BY 1, 2, 3)
SELECT pair_id, dep AS pool FROM ok JOIN nouns USING (pair_id, dep) GROUP BY 1, 2 HAVING count(DISTINCT nouns.side) = 2""")
def noun_pools(spark: SparkSession, sf: str) -> DataFrame:
    return L.candidate_pools(_pairs(spark, sf), separate=True, nouns=True).select("pair_id", "pool")


LEMMA = """lem AS (SELECT p.pair_id, trim(a.lemma) AS src_lemma, trim(b.lemma) AS tgt_lemma FROM pool2 p JOIN ok n ON n.pair_id = p.pair_id AND n.dep = 'nsubj'
 LEFT JOIN tok a ON a.pair_id = p.pair_id AND a.side = 'hun' AND a.id = n.shead LEFT JOIN tok b ON b.pair_id = p.pair_id AND b.side = 'eng' AND b.id = n.thead)"""


@query(f"{TREE}, {LEMMA} SELECT src_lemma, tgt_lemma, count(*) AS n, min(pair_id) AS first_pair FROM lem GROUP BY 1, 2")
def lemma_groups(spark: SparkSession, sf: str) -> DataFrame:
    return A.lemma_groups(L.candidate_pools(_pairs(spark, sf)))


@query(f"{TREE}, {LEMMA} SELECT pair_id AS id, min(pair_id) OVER w AS class_id, count(*) OVER w - 1 AS n_links FROM lem WHERE src_lemma IS NOT NULL AND tgt_lemma IS NOT NULL WINDOW w AS (PARTITION BY src_lemma, tgt_lemma)")
def same_lemma_links(spark: SparkSession, sf: str) -> DataFrame:
    keyed = A.with_predicate_lemmas(L.candidate_pools(_pairs(spark, sf)))
    return J.links_within(keyed, ["src_lemma", "tgt_lemma"], "pair_id")


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    """The shared pool, written once: the draws and both sides of the swaps read it."""
    return materialise(L.candidate_pools(_pairs(spark, sf)))


def _next_pairs(pool: DataFrame) -> DataFrame:
    """Each pool member with the next one in hash order, as a stated set of pairs for the swap queries."""
    at = J.numbered(pool.select("pair_id"), "pair_id", SEED)
    left = at.select(F.col("pos").alias("draw"), F.col("pair_id").alias("pair_a"))
    return left.join(at.select((F.col("pos") - 1).alias("draw"), F.col("pair_id").alias("pair_b")), "draw")


NEXT = f"""place AS (SELECT pair_id, row_number() OVER (ORDER BY {int_sql("'pos'", 'CAST(pair_id AS VARCHAR)')}, pair_id) - 1 AS pos FROM pool2),
draws AS (SELECT a.pos AS draw, a.pair_id AS pair_a, b.pair_id AS pair_b FROM place a JOIN place b ON b.pos = a.pos + 1)"""


def _swap_sql(dep: str, method: str, draws: str = NEXT, original: bool = False) -> str:
    """Both directions of a swap: the words before and after the own span, and in between those of the other's."""
    if dep == "predicate":
        span = "span AS (SELECT pair_id, shead AS slo, shead AS shi, thead AS tlo, thead AS thi FROM ok WHERE dep = 'nsubj' AND shead > 0 AND thead > 0)"
    else:
        span = f"span AS (SELECT pair_id, slo, shi, tlo, thi FROM ok WHERE dep = '{dep}')"
    plain = f""" UNION ALL SELECT 'original_{method}', d.draw, d.pair_a, d.pair_b, d.slot, string_agg(form, ' ' ORDER BY t.id) FILTER (t.side = 'hun'), string_agg(form, ' ' ORDER BY t.id) FILTER (t.side = 'eng') FROM dirs d JOIN tok t ON t.pair_id = d.own
 WHERE EXISTS (SELECT 1 FROM span s WHERE s.pair_id = d.pair_a) AND EXISTS (SELECT 1 FROM span s WHERE s.pair_id = d.pair_b) GROUP BY ALL"""
    return f"""{TREE}, {draws}, {span}, dirs AS (SELECT draw, pair_a, pair_b, 0 AS slot, pair_a AS own, pair_b AS other FROM draws UNION ALL SELECT draw, pair_a, pair_b, 1, pair_b, pair_a FROM draws),
words AS (SELECT d.draw, d.slot, t.side, t.form, CASE WHEN t.id < CASE t.side WHEN 'hun' THEN s.slo ELSE s.tlo END THEN 0 ELSE 2 END AS part, t.id FROM dirs d JOIN span s ON s.pair_id = d.own JOIN tok t ON t.pair_id = d.own
 WHERE NOT t.id BETWEEN CASE t.side WHEN 'hun' THEN s.slo ELSE s.tlo END AND CASE t.side WHEN 'hun' THEN s.shi ELSE s.thi END
 UNION ALL SELECT d.draw, d.slot, t.side, t.form, 1, t.id FROM dirs d JOIN span s ON s.pair_id = d.other JOIN tok t ON t.pair_id = d.other WHERE t.id BETWEEN CASE t.side WHEN 'hun' THEN s.slo ELSE s.tlo END AND CASE t.side WHEN 'hun' THEN s.shi ELSE s.thi END),
txt AS (SELECT draw, slot, string_agg(form, ' ' ORDER BY part, id) FILTER (side = 'hun') AS src, string_agg(form, ' ' ORDER BY part, id) FILTER (side = 'eng') AS tgt FROM words GROUP BY 1, 2)
SELECT '{method}' AS method, d.draw, d.pair_a, d.pair_b, d.slot, src, tgt FROM dirs d JOIN txt USING (draw, slot) WHERE EXISTS (SELECT 1 FROM span s WHERE s.pair_id = d.pair_a) AND EXISTS (SELECT 1 FROM span s WHERE s.pair_id = d.pair_b){plain if original else ''}"""


AUGMENT_SEED = 123


def _draws_sql(pool: str) -> str:
    """The random pairs of a pool: the first k different ones of numbered draws; if most are wanted, all in the order of a hash."""
    i = lambda *parts: int_sql(*parts, seed=AUGMENT_SEED)
    return f"""place AS (SELECT pair_id, row_number() OVER (ORDER BY {i("'pos'", 'CAST(pair_id AS VARCHAR)')}, pair_id) - 1 AS pos FROM {pool}),
size AS (SELECT (SELECT count(*) FROM place) AS n, (SELECT CAST(floor(floor(count(*) * 0.5) / 2) AS BIGINT) FROM both_sides) AS k),
drawn AS (SELECT i AS draw, {i("'x'", 'CAST(i AS VARCHAR)')} % n AS x, {i("'y'", 'CAST(i AS VARCHAR)')} % (n - 1) AS y FROM size, range((SELECT 20 * k + 500 FROM size)) r(i) WHERE n > 1),
firsts AS (SELECT min(draw) AS draw, x, y + (y >= x)::BIGINT AS y FROM drawn GROUP BY ALL),
every AS (SELECT a.pos * n + b.pos AS draw, a.pos AS x, b.pos AS y FROM place a, place b, size WHERE a.pos <> b.pos AND 2 * k > n * (n - 1)),
ranked AS (SELECT draw, x, y, row_number() OVER (ORDER BY draw) AS r FROM firsts, size WHERE 2 * k <= n * (n - 1)
 UNION ALL SELECT draw, x, y, row_number() OVER (ORDER BY {i("'every'", 'CAST(draw AS VARCHAR)')}, draw) FROM every),
draws AS (SELECT draw, a.pair_id AS pair_a, b.pair_id AS pair_b FROM ranked JOIN place a ON a.pos = x JOIN place b ON b.pos = y, size WHERE r <= k)"""


def _augment_sql(separate: bool, original: bool) -> str:
    parts = []
    for dep, method in (("obj", "obj_swapping"), ("nsubj", "subj_swapping")):
        pool = f"(SELECT pair_id FROM ok WHERE dep = '{dep}')" if separate else "pool2"
        parts.append(f"SELECT * FROM ({_swap_sql(dep, method, _draws_sql(pool), original)})")
    return " UNION ALL ".join(parts)


def _swap(dep: str, method: str, name: str) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        pool = _pool(spark, sf)
        return A.swap_pairs(pool, _next_pairs(pool), dep, method)

    f.__name__ = name
    return query(_swap_sql(dep, method))(f)


swap_objects, swap_subjects = _swap("obj", "obj_swapping", "swap_objects"), _swap("nsubj", "subj_swapping", "swap_subjects")


@query(_swap_sql("predicate", "predicate_swapping"))
def swap_predicates(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    return A.swap_pairs(pool, _next_pairs(pool), "predicate", "predicate_swapping")


@query()
def swap_same_lemma(spark: SparkSession, sf: str) -> DataFrame:
    pairs = materialise(_pairs(spark, sf))
    return A.swap_same_lemma(L.candidate_pools(pairs), A.target_pairs(pairs.count(), 0.5), SEED)


@query(_augment_sql(False, True))
def augment_base(spark: SparkSession, sf: str) -> DataFrame:
    return A.augment_by_swapping(L.tree_pairs(_trees(spark, sf)), save_original=True)


@query(_augment_sql(True, False))
def augment_separate(spark: SparkSession, sf: str) -> DataFrame:
    return A.augment_by_swapping(L.tree_pairs(_trees(spark, sf)), separate=True)


@query()
def augment_edge_mapper(spark: SparkSession, sf: str) -> DataFrame:
    return A.augment_by_similarity(L.tree_pairs(_trees(spark, sf)), "edge_mapper", 0.4)


@query()
def augment_ged(spark: SparkSession, sf: str) -> DataFrame:
    return A.augment_by_similarity(L.tree_pairs(_trees(spark, sf)), "ged", 0.5)


@query(f"""WITH x AS ({_swap_sql("obj", "obj_swapping")}), {TOK},
l AS (SELECT pair_id, string_agg(form, ' ' ORDER BY id) FILTER (side = 'hun') || chr(9) || string_agg(form, ' ' ORDER BY id) FILTER (side = 'eng') AS line FROM tok GROUP BY 1)
SELECT a.method, a.pair_a, a.pair_b, concat_ws(chr(10), la.line, lb.line, repeat('-', 20), a.src || chr(9) || a.tgt, b.src || chr(9) || b.tgt, repeat('-', 20)) AS report
FROM x a JOIN x b ON a.draw = b.draw AND a.slot = 0 AND b.slot = 1 JOIN l la ON la.pair_id = a.pair_a JOIN l lb ON lb.pair_id = a.pair_b""")
def augmented_report(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    made = A.swap_pairs(pool, _next_pairs(pool), "obj", "obj_swapping")
    plain = pool.select("pair_id", R.sentence(F.col("src_tokens")).alias("src"), R.sentence(F.col("tgt_tokens")).alias("tgt"))
    return P.report_blocks(made, plain)


@query()
def tree_similarities(spark: SparkSession, sf: str) -> DataFrame:
    pools = L.candidate_pools(_pairs(spark, sf), separate=True)
    objects = pools.where("pool = 'obj'")
    mapped = A.with_similarity(objects, "obj", "edge_mapper").withColumnRenamed("similarity", "edge_mapper").drop("cut_short")
    return A.with_similarity(mapped, "obj", "ged").select("pair_id", "edge_mapper", F.col("similarity").alias("ged"), "cut_short")


@query()
def similarity_experiment(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    return A.similarity_experiment(pool, _next_pairs(pool), "obj")


PROB = f"""WITH RECURSIVE {TOK}, {ANC}, d AS (SELECT pair_id, side, id, exp(1 - power(2.0, 1 - max(n))) AS e FROM anc WHERE a = 0 GROUP BY 1, 2, 3),
p AS (SELECT pair_id, side, id, row_number() OVER w AS pos, e / sum(e) OVER (PARTITION BY pair_id, side) AS prob FROM d WINDOW w AS (PARTITION BY pair_id, side ORDER BY id))"""


@query(f"{PROB} SELECT pair_id, side, CAST(pos AS INTEGER) AS pos, round(prob, 6) AS prob FROM p")
def depth_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf).select("pair_id", "side", F.posexplode(A.depth_probabilities(F.col("tokens"))).alias("pos", "prob"))
    return rows.select("pair_id", "side", (F.col("pos") + 1).alias("pos"), F.round("prob", 6).alias("prob"))


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    rows = _trees(spark, sf).withColumn("p", A.depth_probabilities(t))
    return rows.withColumn("at", A.chosen_positions(F.col("p"), SEED, F.concat_ws("/", "pair_id", "side")))


def _changed_sql(text: str) -> str:
    """Words at up to three positions drawn by the chances of their depth."""
    draw = lambda i: f"SELECT DISTINCT pair_id, side, {int_sql(chr(39) + f'draw{i}' + chr(39), 'pair_id || chr(47) || side')} / 4294967296.0::DOUBLE AS u FROM p"
    return f"""{PROB}, run AS (SELECT *, sum(prob) OVER (PARTITION BY pair_id, side ORDER BY pos) AS s FROM p),
u AS ({' UNION ALL '.join(draw(i) for i in range(3))}),
c AS (SELECT DISTINCT pair_id, side, least(max(pos), count(*) FILTER (s <= u) + 1) AS pos FROM run JOIN u USING (pair_id, side) GROUP BY pair_id, side, u)
SELECT pair_id, side, {text} AS text FROM p JOIN tok USING (pair_id, side, id) LEFT JOIN (SELECT *, true AS hit FROM c) USING (pair_id, side, pos) GROUP BY 1, 2"""


@query(_changed_sql("string_agg(CASE WHEN hit THEN '[BLANK]' ELSE form END, ' ' ORDER BY pos)"))
def blanked_words(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("pair_id", "side", A.blank_words(F.col("tokens"), F.col("at")).alias("text"))


@query(_changed_sql("coalesce(string_agg(form, ' ' ORDER BY pos) FILTER (hit IS NULL), '')"))
def dropped_words(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("pair_id", "side", A.drop_words(F.col("tokens"), F.col("at")).alias("text"))


# ---- scores, vectors, near-duplicates ----

@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("""SELECT a.vec_id, CAST(i AS INTEGER) AS pos, round((a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) / 2, 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (SELECT unnest(range(1, 65)) AS i)""")
def mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    mean = S.mean_vector(F.array("embedding", "b"), 64)
    return e.join(other, "vec_id").select("vec_id", F.posexplode(mean).alias("pos", "value")).select("vec_id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query("""SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(exp(v / norm / 0.5) / sum(exp(v / norm / 0.5)) OVER (PARTITION BY vec_id), 6) AS p FROM (
 SELECT vec_id, i AS pos, embedding[i]::DOUBLE AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings, (SELECT unnest(range(1, 65)) AS i))""")
def softmax_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", F.posexplode(A.softmax_with_temperature(x, 0.5)).alias("pos", "p")).select("vec_id", (F.col("pos") + 1).alias("pos"), F.round("p", 6).alias("p"))


@query()
def sentence_bleu(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "eval_item")
    return items.select("item_id", F.round(S.sentence_bleu(F.col("text"), F.col("ref_text")), 6).alias("bleu"))


@query()
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus_bleu(_h(spark, sf), "hun", "eng")


@query("""WITH i AS (SELECT item_id, text, ref_text, row_number() OVER (ORDER BY item_id) - 1 AS line_no FROM eval_item)
SELECT line_no, text AS original, text || '|' || coalesce(ref_text, '') AS joined FROM i""")
def paired_predictions(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "eval_item").select(((F.col("item_id") - 1001) / 3).cast("bigint").alias("line_no"), "text", F.coalesce("ref_text", F.lit("")).alias("ref"))
    predictions = items.select(F.posexplode(F.array("text", "ref")).alias("k", "value"), "line_no").select((F.col("line_no") * 2 + F.col("k")).alias("line_no"), "value")
    paired = P.pair_predictions(items.select("line_no", F.col("text").alias("value")), predictions, 2)
    return paired.select("line_no", "original", F.array_join("predictions", "|").alias("joined"))


NEAR = r"""w AS (SELECT pair_id AS id, list_filter(string_split_regex(lower(regexp_replace(eng, '[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g')), '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda x: x <> '') AS w FROM hunglish_sampler WHERE eng IS NOT NULL),
g AS (SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) END AS g FROM w WHERE len(w) > 0),
s AS (SELECT min(id) AS set_id, g FROM g GROUP BY g),
e AS (SELECT set_id, len(g) AS n, unnest(g) AS h FROM s),
c AS (SELECT a.set_id AS a, b.set_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.set_id < b.set_id GROUP BY ALL)"""


@query(f"WITH {NEAR} SELECT a, b, round(k / (na + nb - k)::DOUBLE, 6) AS jaccard FROM c WHERE k >= 0.8 * (na + nb - k) - 1e-9")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    sets, _ = N.distinct_sets(_h(spark, sf), "pair_id", "eng")
    return N.near_pairs(sets).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH RECURSIVE {NEAR}, p AS (SELECT a, b FROM c WHERE k >= 0.8 * (na + nb - k) - 1e-9),
bs AS (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS r FROM p GROUP BY b),
go AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS dropped UNION ALL
 SELECT bs.r, CASE WHEN len(list_filter(near, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, b) ELSE dropped END FROM go JOIN bs ON bs.r = go.r + 1),
d AS (SELECT dropped FROM go ORDER BY r DESC LIMIT 1), m AS (SELECT id AS pair_id, min(id) OVER (PARTITION BY g) AS set_id FROM g)
SELECT pair_id, set_id, NOT list_contains(dropped, set_id) AS kept FROM m, d""")
def near_duplicate_leaders(spark: SparkSession, sf: str) -> DataFrame:
    sets, members = N.distinct_sets(_h(spark, sf), "pair_id", "eng")
    return members.join(N.greedy_leaders(sets, N.near_pairs(sets)), "set_id").select(F.col("id").alias("pair_id"), "set_id", "kept")
