"""The folder that all executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quillscan-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def mounted(spark: SparkSession) -> str:
    """shared_dir as a path of this machine, for tools that write files themselves; an error where it is a store without one."""
    path = shared_dir(spark)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: no folder of this machine")
    local = "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    return local


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written to the shared folder (in parts by a column, if given) and read back: lineage ends there and a lost executor costs no recomputation.

    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillscan/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts, groups or joins at once, as a rule.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """spark.sql.shuffle.partitions, or as many tasks as so many rows need."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """df dealt by keys over as many tasks as so many rows need: what a task holds doesn't grow with the input."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)
