"""Cutting lineage through the shared folder of the cluster.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a laptop) a folder of our own
is made. Written tables rather than local checkpoints are used, so that a lost executor costs nothing but its own tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session as a URI or path."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="bitloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/bitloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear_scratch)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, *keys: str, partitions: int | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends there and it is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark)
    out = df if not keys and partitions is None else df.repartition(*([partitions] if partitions else []), *keys)
    out.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path  # for discard
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, such as those of earlier rounds of a loop."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            _written[:] = [w for w in _written if w[1] != path]
            _delete(table.sparkSession, path)


def clear_scratch() -> None:
    """Delete what ``materialise`` wrote in this driver. Results that still read it must be done by then."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            continue
