"""Writing corpora, splits and augmented pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_line(c: Column | str) -> Column:
    """A text as one field of one line: line breaks and tabs as blanks, null as the empty text."""
    return F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "\r\n\t", "   ")


def tab_separated(*columns: str) -> Column:
    """The fields of a line; a null is an empty field."""
    return F.concat_ws("\t", *(one_line(c) for c in columns))


def write_pairs(pairs: DataFrame, path: str, order: str = "pair_id", append: bool = False, src: str = "src", tgt: str = "tgt") -> None:
    """``<path>/src`` and ``<path>/tgt``, text lines in the same order and number: rows are range-sorted once for each side."""
    ordered = pairs.repartitionByRange(order).sortWithinPartitions(order)
    for side, column in (("src", src), ("tgt", tgt)):
        ordered.select(one_line(column).alias("value")).write.mode("append" if append else "overwrite").text(f"{path}/{side}")


def write_augmented(pairs: DataFrame, path: str, layout: str = "tsv") -> None:
    """Augmented pairs by method: tab-separated, or (``basic``) a text file of each side."""
    if layout == "tsv":
        rows = pairs.select("method", tab_separated("src", "tgt").alias("value"))
        rows.write.partitionBy("method").mode("overwrite").text(path)
        return
    if layout != "basic":
        raise ValueError(f"unknown layout {layout!r}")
    for side in ("src", "tgt"):
        ordered = pairs.repartitionByRange("method", "draw", "slot").sortWithinPartitions("method", "draw", "slot")
        ordered.select("method", one_line(side).alias("value")).write.partitionBy("method").mode("overwrite").text(f"{path}/{side}")


def write_splits(rows: DataFrame, path: str, split: str = "new_split", columns: tuple[str, ...] = ("hun", "eng")) -> None:
    """One directory a split with tab-separated columns, no header, no quotes: a line a row."""
    rows.select(split, tab_separated(*columns).alias("value")).write.partitionBy(split).mode("overwrite").text(path)


def write_domains(rows: DataFrame, path: str, domain: str = "domain", columns: tuple[str, ...] = ("hun", "eng")) -> None:
    """One directory of text a domain, columns joined by tabs."""
    rows.select(domain, tab_separated(*columns).alias("value")).write.partitionBy(domain).mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Parquet: the form for tables that only this library reads again."""
    rows.write.mode("overwrite").parquet(path)
