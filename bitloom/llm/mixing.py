"""Mixing sources to target weights by size in tokens."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.skew import prefix_mark
from bitloom.scratch import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that cuts a text before the byte pairs are merged
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of mix targets that the driver holds.
MAX_TARGETS = 100_000
_encodings: dict[bytes, tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of the content of a rank file; kept by the worker."""
    key = hashlib.sha256(ranks).digest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def token_counts(documents: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of the documents whose text is not null; the text itself is left behind.

    The rank file is read by the driver and sent along (about a megabyte), so executors need no file of their own.
    """
    base = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("text is not null")
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return base.mapInArrow(count, f"doc_id {dict(base.dtypes)['doc_id']}, source string, n_tokens bigint")


def plan_mixes(tokens: DataFrame, targets: DataFrame) -> list[dict]:
    """For each target row its budget, what its source has, and the whole epochs and the rest that it is to give.

    The driver gets one number for each source that a target names. Repeated (mix, source) rows count once. Rows with
    a null mix or source are left out; null weights, shares or repeats count as 0.
    """
    goals = targets.where("mix_id is not null and source is not null").dropDuplicates(["mix_id", "source"]).limit(MAX_TARGETS + 1).collect()
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = int(sums.agg(F.sum("n")).first()[0] or 0)
    size = {r["source"]: int(r["n"]) for r in sums.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    out = []
    for g in sorted(goals, key=lambda g: (g["mix_id"], g["source"])):
        wanted = (g["weight"] or 0.0) * (g["budget_share"] or 0.0) * total
        have, most = size.get(g["source"], 0), max(0, int(g["max_repeats"] or 0))
        epochs = min(most, int(wanted // have)) if have and wanted > 0 else 0
        rest = int(wanted - epochs * have) if epochs < most and wanted > 0 else 0
        out.append({"mix_id": g["mix_id"], "source": g["source"], "weight": g["weight"], "size": have, "wanted": float(wanted), "most": most, "epochs": epochs, "rest": rest})
    return out


def mix_documents(tokens: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """``mix_id``, ``source``, ``doc_id``, ``n_tokens``, ``copies``: how often each document is used in each mix.

    A source is used in whole epochs; the rest of its budget is a prefix in the order of a hash of mix and document,
    cut exactly by distributed prefix sums, for all mixes and sources in one pass. So a source that has enough ends at
    most one document below its budget, and one that has not is used up. Only the documents in the range of the hash
    in which a budget ends are shuffled. Repeated rows of a document are documents of their own.
    """
    rows = [(p["mix_id"], p["source"], p["epochs"], p["rest"]) for p in plan]
    goals = tokens.sparkSession.createDataFrame(rows, "mix_id string, source string, epochs int, _budget bigint")
    asked = tokens.join(F.broadcast(goals.select("mix_id", "source")), "source").withColumn("_key", F.xxhash64(F.lit(seed), "mix_id", "doc_id"))
    marked = prefix_mark(asked, ["mix_id", "source"], "_key", "n_tokens", goals, "_budget")
    copies = F.col("epochs") + (F.col("_in") & (F.col("_budget") > 0)).cast("int")
    return marked.select("mix_id", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix_report(tokens: DataFrame, plan: list[dict], mixed: DataFrame) -> DataFrame:
    """For each target row: size of the source, tokens wanted and used, shares wanted and reached, and what fell short.

    All of it comes from the documents that were selected. ``short``: the source was used up (every document as often
    as it may be) and still gave less than its budget.
    """
    rows = [(p["mix_id"], p["source"], p["weight"], p["size"], p["wanted"], p["most"]) for p in plan]
    base = tokens.sparkSession.createDataFrame(rows, "mix_id string, source string, weight double, source_tokens bigint, wanted_tokens double, most int")
    used = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("max_copies"))
    joined = base.join(F.broadcast(used), ["mix_id", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("bigint")))
    all_used = F.sum("used_tokens").over(Window.partitionBy("mix_id"))  # one row a target
    used_up = F.col("used_tokens") == F.col("source_tokens") * F.col("most")
    return joined.withColumns({"share": F.try_divide(F.col("used_tokens"), all_used), "short": used_up & (F.col("used_tokens") < F.col("wanted_tokens"))}).drop("most")


def mixed_corpus(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The documents used by all mixes and the report, from tables with the columns of TESTDATA.md.

    Null texts are left out, empty ones have no tokens; documents without a source count in the total only. An empty
    table of documents gives an empty mix and a report in which nothing was used.
    """
    tokens = materialise(token_counts(documents, "doc_id", "text", "source", tokenizer))
    plan = plan_mixes(tokens, targets)
    mixed = mix_documents(tokens, plan)
    return mixed, mix_report(tokens, plan, mixed)


def mix_checks(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``mix_id, source`` of each target with what must hold for every selection: ``within_budget``, ``near_budget``
    (less than one document missing, or the source used up) and ``repeats_kept``."""
    tokens = materialise(token_counts(documents, "doc_id", "text", "source", tokenizer))
    plan = plan_mixes(tokens, targets)
    report = mix_report(tokens, plan, mix_documents(tokens, plan))
    longest = tokens.groupBy("source").agg(F.max("n_tokens").alias("_longest"))
    most = tokens.sparkSession.createDataFrame([(p["mix_id"], p["source"], p["most"]) for p in plan], "mix_id string, source string, most int")
    joined = report.join(F.broadcast(most), ["mix_id", "source"]).join(longest, "source", "left")
    missing = F.col("wanted_tokens") - F.col("used_tokens")
    return joined.select(
        "mix_id", "source", (missing >= 0).alias("within_budget"),
        (F.col("short") | (missing < F.coalesce("_longest", F.lit(0)) + 1)).alias("near_budget"), (F.coalesce("max_copies", F.lit(0)) <= F.col("most")).alias("repeats_kept"),
    )
