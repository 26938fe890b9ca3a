"""The driver's tables in the roles of articles, sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, language, title, content, score, relevance: documents as articles.

    The score is arithmetic on the id, so that both sides of a comparison agree on it; a few are null.
    """
    docs = table(spark, sf_dir, "documents")
    score = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise((F.col("doc_id") * 7919 % 1000) / F.lit(1000.0))
    return docs.select(
        F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        score.cast("double").alias("score"), (F.col("doc_id") % 4).cast("int").alias("relevance"),
    )


ARTICLES = r"""articles AS (
  SELECT doc_id AS id, source, lang AS language, split_part(text, chr(10), 1) AS title, text AS content,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id * 7919 % 1000) / 1000.0::DOUBLE END AS score, CAST(doc_id % 4 AS INTEGER) AS relevance
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
