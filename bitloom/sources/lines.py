"""Scans of text files: lines, aligned files, tab-separated bitext."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.text import strip_all
from bitloom.operators.sampling import batches


def natural_key(name: Column) -> Column:
    """Sort key of a file name in which runs of digits compare as numbers: 2 comes before 10.

    Digit runs are padded to 20 places; text between them compares as it is.
    """
    padded = F.regexp_replace(F.regexp_replace(name, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return padded


def raw_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``value, file, split, at``: lines with their file, their split of it and a number that ascends within the split.

    Any encoding in which a line ends with the byte of a newline: single-byte ones are read byte by character and
    translated in the JVM, others are decoded by line in Arrow batches. Bytes that an encoding lacks become U+FFFD.
    """
    name = codecs.lookup(encoding).name
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    value = F.col("value")  # the bytes of the line as they are
    if name not in ("utf-8", "ascii"):
        value = F.decode(value.cast("binary"), "ISO-8859-1")
        upper = [bytes([b]) for b in range(128, 256)]
        singles = [b.decode(encoding, "replace") for b in upper]
        if all(len(c) == 1 for c in singles) and (b"".join(upper)).decode(encoding, "replace") == "".join(singles):
            value = value if name == "iso8859-1" else F.translate(value, "".join(map(chr, range(128, 256))), "".join(singles))
        else:
            decode = F.pandas_udf(lambda t: t.map(lambda x: x.encode("latin-1").decode(encoding, "replace")), "string")
            value = decode(value)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return raw.select(value.alias("value"), *place, F.monotonically_increasing_id().alias("at"))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``line_no`` (from 0, through all files in natural order of their paths), ``value`` (without outer white space).

    Lines keep their order within a split of a file; the numbers of lines of the splits (one row each) are summed up
    to offsets and joined back. Nothing is sorted but the splits.
    """
    lines = raw_lines(spark, path, encoding)
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    order = Window.orderBy(natural_key(F.col("file")), "file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "split"]).select((F.col("at") - F.col("first") + F.col("before")).alias("line_no"), strip_all(F.col("value")).alias("value"))


def read_aligned(spark: SparkSession, src: str, tgt: str, encoding: str = "UTF-8") -> DataFrame:
    """``pair_id, src, tgt``: line i of one file with line i of the other, as long as both have lines."""
    left = read_lines(spark, src, encoding).select(F.col("line_no").alias("pair_id"), F.col("value").alias("src"))
    right = read_lines(spark, tgt, encoding).select(F.col("line_no").alias("pair_id"), F.col("value").alias("tgt"))
    return left.join(right, "pair_id")


def read_aligned_batches(spark: SparkSession, src: str, tgt: str, size: int, skip: int = 0) -> DataFrame:
    """read_aligned with ``batch``, leaving out the first ``skip`` batches of ``size`` lines."""
    return batches(read_aligned(spark, src, tgt), "pair_id", size, skip)


def read_combined(spark: SparkSession, src: str, tgt: str) -> DataFrame:
    """``value``: aligned lines joined by a tab."""
    return read_aligned(spark, src, tgt).select("pair_id", F.concat_ws("\t", "src", "tgt").alias("value"))


def read_tsv_bitext(spark: SparkSession, path: str, encoding: str = "ISO-8859-2", trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of tab-separated files ``<domain>/<...>/<file>`` below ``path``.

    rows: ``hun, eng, source_file, domain`` of lines with exactly one tab; malformed: the other non-empty lines with
    their file. Files are read by split, so a file may be of any size.
    """
    lines = raw_lines(spark, path, encoding)
    after = F.substring_index("file", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    placed = lines.select(F.substring_index("file", "/", -1).alias("source_file"), F.substring_index(after, "/", 1).alias("domain"), F.col("value").alias("line")).where("line <> ''")
    parts = F.split("line", "\t")
    good = placed.where(F.size(parts) == 2)
    fix = strip_all if trim else (lambda c: c)
    return good.select(fix(parts[0]).alias("hun"), fix(parts[1]).alias("eng"), "source_file", "domain"), placed.where(F.size(parts) != 2)


def read_translations(spark: SparkSession, path: str, corpus: str, first: str = "en", second: str = "hu") -> DataFrame:
    """``corpus`` and the two fields of the nested ``translation`` of JSON records; other fields are not read."""
    schema = f"translation struct<{first}:string,{second}:string>"
    return spark.read.schema(schema).json(path).select(F.lit(corpus).alias("corpus"), f"translation.{first}", f"translation.{second}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``length`` of the files directly in a directory."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length")
