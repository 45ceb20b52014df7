"""Columns over dependency trees: one array of tokens a sentence, head 0 for the root.

token: id INT, form, lemma, upos STRING, head INT, deprel STRING. Ids may have gaps (tokens that a source lost); a
head that is missing ends the climb like the root does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import key_form, key_index, main_label

TOKEN = "struct<id:int,form:string,lemma:string,upos:string,head:int,deprel:string>"
# fixed values: labels that count twice in the edge mapping
HEAVY_LABELS = ("nmod", "obl", "case", "amod", "advmod")


def none_to_null(c: Column) -> Column:
    """The word None, and the empty string, as null."""
    return F.when(~c.isin("None", ""), c)


def trees_from_edges(edges: DataFrame, keys: tuple[str, ...] = ("pair_id", "side")) -> DataFrame:
    """``keys`` and ``tokens``: the edges of each sentence as one array in the order of their ids.

    Repeated rows count once (of differing rows for one token the smallest); rows whose target key has no index are
    left out.
    """
    token = F.struct(
        key_index(F.col("target_key")).alias("id"),
        key_form(F.col("target_key")).alias("form"),
        none_to_null(F.trim("target_lemma")).alias("lemma"),
        none_to_null(F.col("target_postag")).alias("upos"),
        F.coalesce(key_index(F.col("source_key")), F.lit(0)).alias("head"),
        F.col("target_deprel").alias("deprel"),
    )
    rows = edges.select(*keys, token.alias("t")).where("t.id is not null")
    one = rows.groupBy(*keys, F.col("t.id").alias("_id")).agg(F.min("t").alias("t"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def token_at(tokens: Column, index: Column) -> Column:
    """The token with an id; null if there is none."""
    return F.try_element_at(F.filter(tokens, lambda t: t["id"] == index), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where the body uses it inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def _doubled(tokens: Column, first: Callable[[Column], Column], step: Callable[[Column, Column], Column]) -> Column:
    """An array with a value for the root (first) and each token, made by pointer doubling along the heads.

    first(places): the values to start from; step(own, other): a value joined with that of the place it points to.
    After k rounds a value covers 2^k steps towards the root, so a sentence of n tokens takes about log n rounds of n.
    """

    def run(places: Column) -> Column:
        jump = lambda c: F.transform(c["up"], lambda u: F.element_at(c["up"], u))
        join = lambda c: F.transform(c["value"], lambda v, k: step(v, F.element_at(c["value"], F.element_at(c["up"], k + 1))))
        start = F.struct(places.alias("up"), first(places).alias("value"))
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(tokens) + 2)).cast("int"))
        return F.aggregate(rounds, start, lambda c, _: F.struct(jump(c).alias("up"), join(c).alias("value")))["value"]

    ids = F.transform(tokens, lambda t: t["id"])
    place = lambda known: F.transform(tokens, lambda t: (F.array_position(known, t["head"]) + 1).cast("int"))
    return let(F.concat(F.array(F.lit(1)), let(ids, place)), run)


def subtree_ids(tokens: Column, root: Column) -> Column:
    """Sorted ids of a token and all its descendants; null if ``root`` is null."""
    hits = _doubled(tokens, lambda _: F.concat(F.array(F.lit(False)), F.transform(tokens, lambda t: t["id"] == root)), lambda own, other: own | other)
    ids = let(hits, lambda hit: F.transform(F.filter(tokens, lambda t, k: F.element_at(hit, k + 2)), lambda t: t["id"]))
    return F.when(root.isNotNull(), F.array_sort(ids))


def induced(tokens: Column, ids: Column) -> Column:
    """The tokens with these ids."""
    return F.filter(tokens, lambda t: F.array_contains(ids, t["id"]))


def depths(tokens: Column) -> Column:
    """Edges between each token, in the order of the array, and the artificial root (the root token has depth 1).

    A head that is missing counts as a token under the root. Tokens of a cycle have the number of tokens plus 2.
    """

    def first(places: Column) -> Column:
        one = F.transform(tokens, lambda t, k: F.when((t["head"] != 0) & (F.element_at(places, k + 2) == 1), 2).otherwise(1))
        return F.concat(F.array(F.lit(0)), one)

    most = F.size(tokens) + 2
    found = _doubled(tokens, first, lambda own, other: F.least(own + other, most))
    return let(found, lambda d: F.slice(d, 2, F.size(tokens)))


def with_label(tokens: Column, label: str) -> Column:
    """The tokens whose raw label is exactly ``label``."""
    return F.filter(tokens, lambda t: t["deprel"] == label)


def with_property(tokens: Column, name: str, value: str) -> Column:
    """The tokens with a value of a field."""
    return F.filter(tokens, lambda t: t[name] == value)


def only_with_label(tokens: Column, label: str) -> Column:
    """The single token with a label; null if there is none or more than one."""
    found = with_label(tokens, label)
    return F.when(F.size(found) == 1, found[0])


def root_tokens(tokens: Column) -> Column:
    """Tokens under the artificial root."""
    return F.filter(tokens, lambda t: t["head"] == 0)


def root_token(tokens: Column) -> Column:
    """The first token labelled root, in either case."""
    return F.try_element_at(F.filter(tokens, lambda t: F.lower(t["deprel"]) == "root"), F.lit(1))


def sentence(tokens: Column) -> Column:
    """Forms in the order of ids, with single blanks."""
    return F.array_join(F.transform(F.array_sort(tokens), lambda t: t["form"]), " ")


def is_consecutive(ids: Column) -> Column:
    """Whether sorted ids have no gap; an empty set has none."""
    return (F.size(ids) == 0) | (F.array_max(ids) - F.array_min(ids) + 1 == F.size(ids))


def span(ids: Column) -> Column:
    """Smallest and largest id."""
    return F.struct(F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi"))


def words_without_punctuation(tokens: Column) -> Column:
    """Number of tokens that are no punctuation."""
    return F.size(F.filter(tokens, lambda t: ~t["upos"].eqNullSafe("PUNCT")))


def has_noun(tokens: Column) -> Column:
    """Whether there is a common or proper noun."""
    return F.exists(tokens, lambda t: F.coalesce(t["upos"].isin("NOUN", "PROPN"), F.lit(False)))


def edge_weight(label: Column) -> Column:
    """2 for the heavy labels as they stand, else 1."""
    return F.when(label.isin(*HEAVY_LABELS), 2).otherwise(1)


def label_counts(trees: DataFrame) -> DataFrame:
    """``label``, ``n``: tokens by main label."""
    return trees.select(F.explode("tokens").alias("t")).groupBy(main_label(F.col("t.deprel")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def dot(tokens: Column) -> Column:
    """The tree as text in the DOT language: an edge a line from head to word (root_0 above the root), labelled."""
    back, mark = F.lit("\\"), F.lit('"')
    quoted = lambda c: F.concat(mark, F.replace(F.replace(c, back, F.concat(back, back)), mark, F.concat(back, mark)), mark)
    key = lambda t: F.concat(t["form"], F.lit("_"), t["id"].cast("string"))

    def line(t: Column) -> Column:
        head = F.coalesce(key(token_at(tokens, t["head"])), F.concat(F.lit("root_"), t["head"].cast("string")))
        return F.concat(F.lit("  "), quoted(head), F.lit(" -> "), quoted(key(t)), F.lit(" [label="), quoted(F.coalesce(t["deprel"], F.lit(""))), F.lit("];\n"))

    return F.concat(F.lit("digraph {\n"), F.array_join(F.transform(F.array_sort(tokens), line), ""), F.lit("}"))
