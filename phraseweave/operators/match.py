"""Scores of sentence patterns against learnt relations, and candidate relations by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position_score(a: Column, b: Column) -> Column:
    return F.pow(1 - F.abs(a - b), 2)


def type_score(entities: DataFrame, probabilities: DataFrame, allow_unknown: bool = True) -> DataFrame:
    """(id, relation, score) of entities (id, relation, types): the sum of learnt probabilities (relation, type, probability) of their types, for each type they have.

    Without types: null, or 0 if unknown types aren't allowed.
    """
    exploded = entities.select("id", "relation", F.size("types").alias("n"), F.explode_outer("types").alias("type"))
    joined = exploded.join(probabilities, ["relation", "type"], "left")
    total = joined.groupBy("id", "relation").agg(F.max("n").alias("n"), F.sum("probability").alias("found"))
    return total.select("id", "relation", F.when(F.col("n") > 0, F.coalesce("found", F.lit(0.0)) / F.col("n")).otherwise(F.lit(None if allow_unknown else 0.0).cast("double")).alias("score"))


def one_way_type_score(new: DataFrame, learnt: DataFrame) -> DataFrame:
    """(relation, score): the share of the learnt counts (relation, type, n) whose type is among the new ones (relation, type)."""
    seen = learnt.join(new.select("relation", "type").distinct().withColumn("seen", F.lit(True)), ["relation", "type"], "left")
    return seen.groupBy("relation").agg((F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))


def syntax_score(common: Column, words_a: Column, count_a: Column, words_b: Column, count_b: Column) -> Column:
    """How much two patterns of so many words and covered sentences have in common, 1 at most; 0 for an empty pattern."""
    share = F.pow(common / F.least(count_a, count_b), 2) / (words_a / count_a) / (words_b / count_b)
    return F.when((words_a > 0) & (words_b > 0), F.least(F.lit(1.0), share)).otherwise(F.lit(0.0))


def weighted_mean(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean of scores by weights; a null score takes its weight with it."""
    top = sum((F.when(s.isNotNull(), s * w).otherwise(0.0) for s, w in pairs), F.lit(0.0))
    return F.try_divide(top, sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in pairs), F.lit(0.0)))


def match_score(subject: Column, object_: Column, position: Column, syntax: Column, subject_weight: Column, object_weight: Column, position_weight: float = 0.15, syntax_weight: float = 1.0, type_matching: bool = True) -> Column:
    """Overall score: 0 where a type score is 0, else the mean of all; syntax alone without type matching."""
    if not type_matching:
        return syntax
    mean = weighted_mean([(subject, subject_weight), (object_, object_weight), (position, F.lit(position_weight)), (syntax, F.lit(syntax_weight))])
    return F.when((subject == 0) | (object_ == 0), F.lit(0.0)).otherwise(mean)


def candidate_relations(entities: DataFrame, entity_type: DataFrame, relation_types: DataFrame, relations: DataFrame, allow_unknown: bool = True) -> DataFrame:
    """(entity, relation): relations that know a type of the entity; all of them for entities without types, where allowed.

    ``relations`` is the list of learnt relations. An entity without types gets each of them in a row, whatever their number.
    """
    distinct = entities.select("entity").distinct()
    found = distinct.join(entity_type, "entity").join(relation_types.select("relation", "type").distinct(), "type").select("entity", "relation").distinct()
    if not allow_unknown:
        return found
    every = relations.select("relation").distinct().agg(F.collect_list("relation").alias("every"))  # one row
    untyped = distinct.join(entity_type, "entity", "left_anti").crossJoin(F.broadcast(every))
    return found.union(untyped.select("entity", F.explode("every").alias("relation")))


def candidates_of_pairs(pairs: DataFrame, subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(pair_id, relation): relations that are candidates of both ends of pairs (pair_id, subject, object)."""
    left = pairs.join(subjects.select(F.col("entity").alias("subject"), "relation"), "subject")
    right = objects.select(F.col("entity").alias("object"), "relation")
    return left.join(right, ["object", "relation"]).select("pair_id", "relation")
