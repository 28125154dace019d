"""The corpus pipeline: documents pass quality, toxicity, near-duplicate and packing stages in turn.

A stage judges rows by their texts alone: null ids and repeated rows stay or go as their texts say, other
columns are carried along whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseweave.llm.common import Workspace, fold
from phraseweave.llm.jaccard import keep_one
from phraseweave.llm.packing import pack_documents
from phraseweave.llm.quality import drop_low_quality
from phraseweave.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose text the highest quality grade is likelier than not, or as likely.

    Null and empty texts go by the share of grades among the labels; without two grades to learn from all stay.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't predicted toxic (a score of 0.5 is).

    Null and empty texts go by the share of toxic labels; without labels all stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word runs, Jaccard 0.8 or more): the smallest id's.

    Ties go by the text's hash, then by the other columns. Null and empty texts, and those without words, all stay.
    """
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left as sequences of at most 1024 tokens; null and empty texts are their end alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packing)]

#: Trained scores and set similarity with a group choice have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
