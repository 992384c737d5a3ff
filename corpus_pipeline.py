"""A pipeline over documents: toxicity filter, language filter, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, in all their columns; the last gives
the packed pieces. Every stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm import language, near_dedup, packing, toxicity
from quillscan.llm.common import saved, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the limit; the machine learns from labels of these documents.

    Null and empty texts have the score of a text without telling words and stay.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flagged = toxicity.score(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), machine, "_text")
    return flagged.where("predicted = 0").select("_row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus: those without any letter (null and empty texts too) and those of a score under the models' fitted limit go.

    Where no document has a language to learn from, all stay.
    """
    models = language.fit(docs)
    if not models.langs:
        return docs
    found = language.identify(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), models, "_text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= models.reject)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id; of rows that repeat an id and a text, one stays.

    Documents without words and rows without an id stay, and so do other texts of a repeated id.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _of_repeated_ids(docs)
    gone = saved(near_dedup.find(docs).where(~F.col("kept")).select("doc_id").distinct(), "removed")
    return docs.join(F.broadcast(gone) if gone.count() <= near_dedup.MOST_SENT else gone, "doc_id", "left_anti").select(*docs.columns)


def _of_repeated_ids(docs: DataFrame) -> DataFrame:
    """The same where an id doesn't tell a document: rows are linked by numbers of their own, the smallest id still stays."""
    row = unused(docs, "_row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = rows.where("doc_id is not null")
    found = near_dedup.find(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("_of"))
    first = F.min(F.struct("doc_id", F.xxhash64("text").alias("tie"), row))
    stays = named.select(row, "doc_id", "text").join(found, row).groupBy("_of").agg(first.alias("x")).select(f"x.{row}")
    kept = named.join(stays, row, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(rows.where("doc_id is null")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL cannot express trained models; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
