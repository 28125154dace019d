"""Delimited tables and stores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A #-delimited file without quoting or header."""
    return spark.read.csv(path, sep="#", quote="", schema=", ".join(f"`{c}` string" for c in columns))


def write_delimited(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="#", quote="", header=header)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ["entity", "type"])


def read_inheritance(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(read_delimited(spark, path, ["type", "parent"]).withColumn("line_no", F.monotonically_increasing_id()), "type", "parent")


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(read_delimited(spark, path, ["src", "dst"]).withColumn("line_no", F.monotonically_increasing_id()), "src", "dst")


def read_types_index(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(entity, type) of lines with an entity and its types joined by underscores."""
    lines = read_delimited(spark, path, ["entity", "types"])
    if limit is not None:
        lines = lines.orderBy(F.monotonically_increasing_id()).limit(limit)  # the first lines
    return lines.select("entity", F.explode(F.split("types", "_")).alias("type"))


def last_wins(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key, the value of its last line."""
    return rows.groupBy(key).agg(F.max_by(value, "line_no").alias(value))


class Store(Mapping):
    """A folder of Parquet tables, each read when it is asked for; ``tables`` names those that it may have, none: any."""

    tables: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, **tables: DataFrame) -> None:
        if unknown := sorted(set(tables) - set(self.tables)) if self.tables else []:
            raise ValueError(f"no tables of this store: {', '.join(unknown)}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or self.tables and name not in self.tables:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __getitem__(self, name: str) -> DataFrame:
        if self.tables and name not in self.tables:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


class PatternStore(Store):
    """What was learnt of relations in text."""

    tables = ("pattern_word", "pattern_type", "pattern_meta", "training_resource")


class TypeStore(Store):
    """What was learnt of the types of relations."""

    tables = ("type_pattern", "type_pattern_type")


def write_page_index(pages: DataFrame, path: str) -> None:
    """title#position lines, sorted by title over all files."""
    write_delimited(pages.select("title", F.col("position").cast("string").alias("position")).orderBy("title"), path)


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ["title", "position"]).withColumn("position", F.col("position").cast("long"))
