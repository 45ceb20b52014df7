"""Preprocessing of bitext that keeps arriving: files are read once, batches are written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BITEXT = "pair_id bigint, src string, tgt string, ingested_at timestamp"


def stream_pairs(spark: SparkSession, path: str, schema: str = BITEXT, files_a_batch: int = 100) -> DataFrame:
    """Parquet files below ``path`` as they arrive, at most ``files_a_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_increments(pairs: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch job to each increment and write it below ``out/increment=<n>``.

    The directory of an increment is replaced as a whole, so an increment that is repeated after a failure leaves one
    copy. Ends when all files that are there have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/increment={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(pairs: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """The first row of each key; copies that arrive within ``delay`` are dropped and the state is bounded by it.

    Rows without a time count as arriving now.
    """
    timed = pairs.withColumn(time, F.coalesce(time, F.current_timestamp()))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals_by_window(pairs: DataFrame, by: str, time: str = "ingested_at", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """``start``, ``by``, ``n``: rows by tumbling window and group; what is later than ``delay`` is left out."""
    grouped = pairs.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), by, "n")
