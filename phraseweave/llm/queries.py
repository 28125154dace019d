"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseweave.llm.common import fold
from phraseweave.llm.hilbert_search import nearest_neighbours
from phraseweave.llm.imatch import fingerprint_edits
from phraseweave.llm.jaccard import jaccard_join, join_sql
from phraseweave.llm.language_model import score_language_model
from phraseweave.llm.license_scan import scan_licenses, scan_sql
from phraseweave.llm.packing import pack_documents
from phraseweave.llm.quality import grade_quality
from phraseweave.llm.sentencepiece_codec import digest_documents
from phraseweave.llm.toxicity import score_toxicity
from phraseweave.llm.warc import DIGESTS_SQL, archive_digests


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_warc_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_language_model(docs, fold(docs["doc_id"], 7) != 2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grade_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return graded.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "keep")


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_boundaries": op2_warc_boundaries,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_approximate_neighbours": op5_approximate_neighbours,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLES: dict[str, str] = {"op1_license_scan": scan_sql(), "op2_warc_boundaries": DIGESTS_SQL, "op6_ngram_jaccard_join": join_sql()}
