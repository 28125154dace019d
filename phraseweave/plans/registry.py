"""Where queries and their SQL are registered, and the forms that results share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def joined(c: str = "path") -> Column:
    return F.array_join(c, "/").alias(c)


def whole(n: Column | str, name: str) -> Column:
    return (F.col(n) if isinstance(n, str) else n).cast("bigint").alias(name)
