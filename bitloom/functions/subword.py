"""Subword pieces by a public sentencepiece model (never trained here)."""

from __future__ import annotations

import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bitloom.functions.types import INTS

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def encode(c: Column, path: str) -> Column:
    """Piece numbers of a text; null stays null. The model is loaded once a worker."""

    @F.pandas_udf(INTS)
    def run(texts: pd.Series) -> pd.Series:
        model = _model(path)
        return texts.map(lambda t: None if t is None else model.encode(t))

    return run(c)


def decode(c: Column, path: str) -> Column:
    """The text of piece numbers; null stays null."""

    @F.pandas_udf(StringType())
    def run(pieces: pd.Series) -> pd.Series:
        model = _model(path)
        return pieces.map(lambda p: None if p is None else model.decode([int(i) for i in p]))

    return run(c)
