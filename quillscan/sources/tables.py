"""Views of input: text lines of tables, source files of a directory, and the languages of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The language of each file extension.
EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".go": "go", ".java": "java", ".php": "php",
}
#: Folders that are never scanned.
EXCLUDED = [".git", "node_modules", "dist", "build", ".venv", "venv", "__pycache__"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a line: keys, line_no (from 1, long) and line. A null text has no lines."""
    split = df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("_n", "line"))
    return split.select(*keys, (F.col("_n") + 1).cast("long").alias("line_no"), "line")


def language_of(path: Column) -> Column:
    """The language of a path's extension (after its last dot, case-sensitive), or null."""
    ext = F.regexp_extract(path, r"(\.[^.]*)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def source_files(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """path (relative to root), lang and content of the files under root; unsupported ones have a null lang."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file://", "")
    path = F.regexp_replace("path", "^file:(//)?", "")
    rel = F.substring(path, F.length(base) + 1, F.length(path))
    kept = ~F.arrays_overlap(F.split(rel, "/"), F.lit(excluded or EXCLUDED))
    return raw.where(kept).select(rel.alias("path"), language_of(rel).alias("lang"), F.decode("content", "UTF-8").alias("content"))


def skipped(files: DataFrame) -> DataFrame:
    """Files that no parser takes, with the reason."""
    return files.where("lang is null").select("path", F.lit("unsupported language").alias("reason"))
