"""Triples as text lines: scanning, cleaning, limits by line, writing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseweave.functions.uri import abbreviated_type, clean_name
from phraseweave.session import parts_of, stored

#: Rows that a task gathers before it drops those behind the first ones of their predicate, and the most it keeps of those.
GATHERED, KEPT = 50_000, 500_000


def parse_triples(lines: DataFrame) -> DataFrame:
    """s, p, o of lines (column value) with exactly three <...> groups; subjects with __ are left out. Other columns stay."""
    groups = F.regexp_extract_all("value", F.lit("<([^>]+)>"), 1)
    parsed = lines.withColumn("groups", groups).filter(F.size("groups") == 3)
    parsed = parsed.select(*(c for c in lines.columns if c != "value"), F.col("groups")[0].alias("s"), F.col("groups")[1].alias("p"), F.col("groups")[2].alias("o"))
    return parsed.filter(~F.contains("s", F.lit("__")))


def scan_triples(spark: SparkSession, path: str) -> DataFrame:
    """line_no, s, p, o of N-Triples files. line_no rises with the order of files and lines, with gaps; store it to keep it."""
    return parse_triples(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no")))


def from_share(facts: DataFrame, share: float) -> DataFrame:
    """Facts behind the line at a share of the first half of the lines."""
    start = facts.agg((F.max("line_no") / 2 * share).cast("long").alias("start"))
    return facts.crossJoin(F.broadcast(start)).filter("line_no > start").drop("start")  # one row


def from_random_line(facts: DataFrame, seed: int | None = None) -> DataFrame:
    """Facts behind a random one of the first half of the lines."""
    return from_share(facts, random.Random(seed).random())


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def cleaned_names(facts: DataFrame) -> DataFrame:
    return facts.withColumns({c: clean_name(F.col(c)) for c in ("s", "p", "o")})


def triple_line(s: Column, p: Column, o: Column) -> Column:
    return F.format_string("<%s> <%s> <%s> .", s, p, o)


def write_triples(facts: DataFrame, path: str) -> None:
    facts.select(triple_line(F.col("s"), F.col("p"), F.col("o")).alias("value")).write.mode("overwrite").text(path)


def write_scored(facts: DataFrame, path: str) -> None:
    """Extracted facts with their score and sentence, as JSON lines."""
    facts.select("s", "p", "o", "score", "sentence").write.mode("overwrite").json(path)


def clean_assertions(facts: DataFrame, predicates: list[str], complain: bool = False) -> DataFrame:
    """(entity, type) of facts with one of the predicates; complain: any other predicate, or a delimiter in a name, is an error."""
    wanted = F.col("p").isin(predicates)
    if complain:
        facts = facts.filter(F.when(wanted, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unexpected predicate "), F.col("p")))))
    else:
        facts = facts.filter(wanted)
    out = facts.select(clean_name(F.col("s")).alias("entity"), abbreviated_type(F.col("o")).alias("type"))
    if complain:
        out = out.filter(F.when(~F.contains("entity", F.lit("#")) & ~F.contains("type", F.lit("#")), F.lit(True)).otherwise(F.raise_error(F.lit("# in a name"))))
    return out


def first_by_line(facts: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` facts by line; 0: all."""
    return facts.orderBy("line_no").limit(limit) if limit else facts


def firsts(table: pa.Table, limit: int) -> pa.Table:
    """The first ``limit`` rows of each p, by line_no."""
    code = table.column("p").combine_chunks().dictionary_encode(null_encoding="encode").indices
    order = pc.sort_indices(pa.table({"p": code, "line_no": table.column("line_no")}), sort_keys=[("p", "ascending"), ("line_no", "ascending")], null_placement="at_start").to_numpy()
    p = code.to_numpy(zero_copy_only=False)[order]
    return table.take(pa.array(order[np.arange(len(p)) - np.searchsorted(p, p) < limit]))


def firsts_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The first rows of each predicate among these, and some others where there are many predicates: what is kept at once is bounded."""
    kept, more, rows = [], [], 0
    for batch in batches:
        more.append(batch)
        rows += batch.num_rows
        if rows >= max(GATHERED, sum(b.num_rows for b in kept)):
            kept, more, rows = firsts(pa.Table.from_batches([*kept, *more]), limit).to_batches(), [], 0
            if sum(b.num_rows for b in kept) > KEPT:
                yield from kept
                kept = []
    if kept or more:
        yield from firsts(pa.Table.from_batches([*kept, *more]), limit).to_batches()


def first_of_each(facts: DataFrame, limit: int) -> DataFrame:
    """The first facts of each predicate, by line: a task hands on the first ones of its own, and doesn't sort or hold the others."""
    order = Window.partitionBy("p").orderBy("line_no")
    found = facts.mapInArrow(lambda batches: firsts_of(batches, limit), facts.schema)
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def first_per_predicate(facts: DataFrame, predicates_limit: int, facts_limit: int) -> DataFrame:
    """Of the predicates that appear first, the first facts of each, by line."""
    rows = stored(first_of_each(facts, facts_limit))  # has the first line of every predicate, so facts are read once
    kept = rows.groupBy("p").agg(F.min("line_no").alias("first")).orderBy("first").limit(predicates_limit).select("p")
    return rows.join(F.broadcast(kept), "p", "left_semi")


def training_facts(facts: DataFrame, test_subjects: DataFrame, relations: list[str], predicates_limit: int, facts_limit: int) -> DataFrame:
    """Facts to learn from: of wanted relations (none named: all), no test subject, then limited."""
    if relations:
        facts = facts.filter(F.col("p").isin(relations))
    parts = parts_of(facts, test_subjects)
    tested = test_subjects.select("s", F.lit(True).alias("tested")).repartition(parts, "s")
    # not an anti join, which the optimizer moves below the repartition, where it shuffles once more
    fresh = facts.repartition(parts, "s").join(tested, "s", "left").filter("tested is null").drop("tested")
    return first_per_predicate(fresh, predicates_limit, facts_limit)


def test_facts(facts: DataFrame, per_relation: int) -> DataFrame:
    """The first facts of each relation, which are no more in all than that times the relations."""
    return first_of_each(facts, per_relation)


def first_entities(facts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` subjects that appear first."""
    return facts.groupBy("s").agg(F.min("line_no").alias("first")).orderBy("first").limit(limit)
