"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and all but the last return
the columns of documents. Every stage is written as Parquet in the shared folder and read back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard, line_dedup, mixing, packing, quality
from tidemill.llm.common import cut, documents, labels
from tidemill.llm.tokens import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return shaped(quality.keep_good(docs, labels(spark, sf_dir)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; documents of which no word is left go with them."""
    kept = line_dedup.drop_repeated_lines(docs)
    return shaped(kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id."""
    return shaped(jaccard.keep_first(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document comes as often as it is taken, the last one of a source cut."""
    return shaped(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the place of each in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Forests, MinHash and packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
