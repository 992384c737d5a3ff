"""What the operators share: the folder for intermediate tables, bounded Arrow batches and null-safe columns."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.sources.shared import remove, saved, shared_dir

__all__ = ["bounded_batches", "give_back", "held_out", "remove", "saved", "shared_dir", "table", "unused"]

#: Rows and bytes that one Arrow batch holds at most; a batch is the unit of a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns a worker's freed memory to the system at a partition's end; idle workers would hold it beside the next stage's."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no classifier learns from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many marks before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
