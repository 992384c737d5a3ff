"""Continuous scanning of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.plans import scan
from quillscan.sources.tables import language_of


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of files under root: path, lang, content."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return raw.select("path", language_of(F.col("path")).alias("lang"), F.decode("content", "UTF-8").alias("content"))


def watch(files: DataFrame, target: str, checkpoint: str, options: scan.Options | None = None, once: bool = True):
    """Appends the findings of each batch of files to Parquet at target; a batch that is replayed replaces its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        found = scan.findings(batch, options).select("file", "line", "rule_id", "severity", "cwe", "confidence", "text", "fingerprint")
        found.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    out = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
