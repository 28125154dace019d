"""Triples that arrive as files: parsed and held against a static knowledge base, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseweave.sources.rdf import parse_triples


def stream_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of the N-Triples files that appear in a folder."""
    return parse_triples(spark.readStream.text(path))


def unknown_triples(stream: DataFrame, known: DataFrame) -> DataFrame:
    """The stream's triples that the static table doesn't have; repeats in the stream stay."""
    there = known.select("s", "p", "o").distinct().withColumn("there", F.lit(True))
    return stream.join(there, ["s", "p", "o"], "left").filter(F.col("there").isNull()).drop("there")
