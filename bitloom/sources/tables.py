"""Delimited tables, configuration and result files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """A delimited table with a given schema (never inferred: one scan); without a quote sign quotes and backslashes are characters."""
    if quote:
        return spark.read.schema(schema).csv(path, sep=sep, header=header, quote=quote)
    return spark.read.schema(schema).csv(path, sep=sep, header=header, quote="\0", escape="\0", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_config(path: str) -> dict[str, Any]:
    """A YAML file as nested dictionaries; an empty file is an empty dictionary."""
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


@dataclass(frozen=True)
class PreprocessConfig:
    """Limits and languages of preprocessing; unknown keys are refused."""

    source_language: str
    target_language: str
    total_wordcount_min: int = 0
    total_wordcount_max: int = 32
    wordcount_diff: int = 7
    wordcount_ratio_threshold: float = 1.2
    langdetect_model_path: str | None = None
    batch_size: int = 10_000
    use_multiprocessing: bool = False
    process_count: int = 1

    @classmethod
    def of(cls, values: dict[str, Any]) -> PreprocessConfig:
        own = values.get("preprocessor", values)
        unknown = set(own) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**own)


def flatten(config: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested keys joined by dots; lists stay whole."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def parent_paths(config: Any, up: str = "../") -> Any:
    """The same configuration with each relative path one directory deeper (strings that start with ./ or ../)."""
    if isinstance(config, dict):
        return {k: parent_paths(v, up) for k, v in config.items()}
    if isinstance(config, list):
        return [parent_paths(v, up) for v in config]
    return up + config if isinstance(config, str) and config.startswith(("./", "../")) else config


def read_score(path: str) -> dict[str, float]:
    """Scores of a result file: JSON with its numbers, or a line of text whose score follows an equals sign."""
    text = Path(path).read_text(encoding="utf-8").strip()
    try:
        data = json.loads(text)
        return {k: float(v) for k, v in data.items() if isinstance(v, int | float)} if isinstance(data, dict) else {"score": float(data)}
    except ValueError:
        m = re.search(r"=\s*(-?\d+(?:\.\d+)?)", text)
        return {"score": float(m[1])} if m else {}


def append_history(spark: SparkSession, history: DataFrame | None, config: dict[str, Any], score: dict[str, float], date: str, path: str, git_hash: str) -> DataFrame:
    """The history with one more row: the flattened configuration and the result; new keys are new columns, null before."""
    row = {k: None if v is None else str(v) for k, v in flatten(config).items()} | {"date": date, "path": path, "git_hash": git_hash} | {k: str(v) for k, v in score.items()}
    schema = ", ".join(f"`{k}` string" for k in row)
    new = spark.createDataFrame([tuple(row.values())], schema)
    return new if history is None else history.unionByName(new, allowMissingColumns=True)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated history, all columns text."""
    return spark.read.csv(path, sep="\t", header=True)


def upsert_status(status: DataFrame, run: str, state: str, result: str | None = None) -> DataFrame:
    """Run states with one run replaced or added (``run, state, result``)."""
    new = status.sparkSession.createDataFrame([(run, state, result)], "run string, state string, result string")
    return status.where(F.col("run") != run).unionByName(new)


def steps_per_epoch(sentences: int, tokens_per_sentence: float, batch_tokens: int) -> int:
    """Training steps of one epoch."""
    return int(sentences * tokens_per_sentence / batch_tokens)


def mixing_weights(ratio: float) -> tuple[int, int]:
    """(original, augmented) weights of a corpus mix: augmented data ratio times as often, or the inverse fraction."""
    from fractions import Fraction

    if ratio >= 1:
        return 1, int(ratio)
    f = Fraction(1 / ratio).limit_denominator(1000)
    return f.numerator, f.denominator


def experiment_grid(axes: dict[str, list[Any]], repeats: int) -> list[dict[str, Any]]:
    """Every combination of the axes, ``repeats`` times with run numbers from 1."""
    from itertools import product

    return [dict(zip(axes, values, strict=True)) | {"run": r} for values in product(*axes.values()) for r in range(1, repeats + 1)]


def corpus_files(directory: str, src: str, tgt: str) -> dict[str, dict[str, str]]:
    """``name: {path_src, path_tgt}`` of the files ``<name>.<src>`` and ``<name>.<tgt>`` of a directory; others than ``.sp`` are refused."""
    out: dict[str, dict[str, str]] = {}
    for f in sorted(p for p in Path(directory).iterdir() if p.is_file()):
        end = f.suffix[1:]
        if end in (src, tgt):
            out.setdefault(f.stem.replace("-", "_"), {})["path_src" if end == src else "path_tgt"] = str(f)
        elif end != "sp":
            raise ValueError(f"{f.name} is of neither side")
    return out


def write_train_configs(base: dict[str, Any], directory: str, out: str, src: str, tgt: str, prefix: str = "run") -> list[str]:
    """A ``config.yaml`` below ``out`` for each corpus directory in ``directory``: the base with its files under ``data``."""
    written = []
    for corpus in sorted(p for p in Path(directory).iterdir() if p.is_dir()):
        at = Path(out) / f"{prefix}-{src}{tgt}-{corpus.name}" / "config.yaml"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(yaml.safe_dump(base | {"data": corpus_files(str(corpus), src, tgt)}, allow_unicode=True, sort_keys=True), encoding="utf-8")
        written.append(str(at))
    return written
