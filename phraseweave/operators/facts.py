"""Discovering, extracting and judging facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseweave.functions.uri import clean_name
from phraseweave.operators import match
from phraseweave.session import parts_of


def discovery_entities(facts: DataFrame, trained: DataFrame, entity_type: DataFrame, relation_types: DataFrame, limit: int, allow_unknown: bool = True) -> DataFrame:
    """The ``limit`` first subjects that weren't trained on and have a type that some relation knows (or none, where allowed)."""
    fresh = facts.join(trained.select("s").distinct(), "s", "left_anti").groupBy("s").agg(F.min("line_no").alias("first")).withColumn("entity", clean_name(F.col("s")))
    known = entity_type.join(relation_types.select("type").distinct(), "type", "left_semi").select("entity").distinct()
    kept = fresh.join(known, "entity", "left_semi")
    if allow_unknown:
        kept = kept.union(fresh.join(entity_type.select("entity"), "entity", "left_anti"))
    return kept.orderBy("first", "s").limit(limit).select("s", "first")


def occurrences(facts: DataFrame, links: DataFrame, without_self: bool = False) -> DataFrame:
    """(sentence_id, s, p, o, link): facts whose object a sentence of their subject's article links (sentence_id, s, link). Repeated facts repeat."""
    keyed = facts.withColumn("link", F.concat(F.lit("/wiki/"), F.substring_index("o", "/", -1)))
    found = keyed.join(links.select("sentence_id", "s", "link").distinct(), ["s", "link"])
    if without_self:
        found = found.filter(F.substring_index("s", "/", -1) != F.substring_index("o", "/", -1))
    return found.select("sentence_id", "s", "p", "o", "link")


def scored_objects(parts: DataFrame, pattern_word: DataFrame, meta: DataFrame, weights: DataFrame, threshold: float = 0.5, position_weight: float = 0.15, syntax_weight: float = 1.0, type_matching: bool = True, allow_unknown: bool = True, keep: Sequence[str] = ("sentence",)) -> DataFrame:
    """Facts of objects (pattern_id, s, o, relative_position, own, common, subject_scores, object_scores) whose match with a candidate relation reaches the threshold.

    Returns pattern_id, s, p, o, the kept columns, subject_score, object_score, position, syntax, score. ``common`` has (relation, n); scores of
    an end (relation, score) are null without types: then every relation is a candidate there, where allowed, and the score takes no part.
    Learnt relations, some dozens, are one row, so an object meets them where it is.
    """
    relations = pattern_word.groupBy("relation").agg(F.sum("n").alias("learnt")).join(meta.withColumnRenamed("relative_position", "mean_position"), "relation").join(weights, "relation")
    every = relations.agg(F.collect_list(F.struct(*relations.columns)).alias("every"))  # one row
    rows = parts.crossJoin(F.broadcast(every)).select(*parts.columns, F.inline("every"))
    of = lambda column: F.get(F.filter(column, lambda x: x["relation"] == F.col("relation")), F.lit(0))
    for side in ("subject", "object"):
        known, fit = F.col(f"{side}_scores").isNotNull(), of(f"{side}_scores")
        if type_matching:
            rows = rows.filter(F.when(known, fit.isNotNull()).otherwise(F.lit(allow_unknown)))
        score = F.when(known, F.coalesce(fit["score"], F.lit(0.0))).otherwise(F.lit(None if allow_unknown else 0.0).cast("double"))
        rows = rows.withColumn(f"{side}_score", score)
    shared = F.coalesce(of("common")["n"], F.lit(0))
    parts = {"syntax": match.syntax_score(shared, F.col("own"), F.lit(1), F.col("learnt"), F.col("covered_sentences")), "position": match.position_score(F.col("relative_position"), F.col("mean_position"))}
    score = match.match_score(F.col("subject_score"), F.col("object_score"), F.col("position"), F.col("syntax"), F.col("subject_weight"), F.col("object_weight"), position_weight, syntax_weight, type_matching)
    out = rows.withColumns(parts).withColumn("score", score).filter(F.col("score") >= threshold).filter(~F.contains("o", F.lit("redlink=1")))
    return out.select("pattern_id", "s", F.col("relation").alias("p"), "o", *(c for c in keep if c not in ("pattern_id", "s", "o")), "subject_score", "object_score", "position", "syntax", "score")


def by_score(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("score"), "s", "p", "o")


def fact_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, p, o, first, last): the distinct facts of two tables, and the first and the last (0: a, 1: b) that has each; nulls are equal.

    Both are grouped in one shuffle, without a sort, by as many tasks as their size needs.
    """
    rows = a.select("s", "p", "o", F.lit(0).alias("side")).union(b.select("s", "p", "o", F.lit(1).alias("side")))
    return rows.repartition(parts_of(a, b), "s", "p", "o").groupBy("s", "p", "o").agg(F.min("side").alias("first"), F.max("side").alias("last"))


def new_facts(extracted: DataFrame, known: DataFrame) -> DataFrame:
    return fact_sides(extracted, known).filter("last = 0").select("s", "p", "o")


def same_facts(a: DataFrame, b: DataFrame) -> bool:
    return not fact_sides(a, b).filter("first = last").limit(1).count()


def coverage(targets: DataFrame, matched: DataFrame) -> DataFrame:
    """(p, total, covered, percent): facts to find, and how many occurrences were found, no more than those."""
    total, found = (x.groupBy("p").agg(F.count("*").alias(n)) for x, n in ((targets, "total"), (matched, "found")))
    both = total.join(found, "p", "left").withColumn("covered", F.least("total", F.coalesce("found", F.lit(0))))
    return both.select("p", "total", "covered", (100 * F.col("covered") / F.col("total")).alias("percent"))


def judged(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Extracted facts with ``right``: whether they are among the true ones. Repeats stay."""
    true = truth.select("s", "p", "o").distinct().withColumn("hit", F.lit(True))
    return extracted.join(true, ["s", "p", "o"], "left").withColumn("right", F.col("hit").isNotNull()).drop("hit")


def evaluation(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """(p, known, right, wrong, precision, recall, f) for each relation of the truth; null where nothing can be divided."""
    known = truth.select("s", "p", "o").distinct().groupBy("p").agg(F.count("*").alias("known"))
    counts = judged(extracted, truth).groupBy("p").agg(F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong"))
    rows = known.join(counts, "p", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("right", "wrong")})
    rows = rows.withColumns({"precision": F.try_divide("right", F.col("right") + F.col("wrong")), "recall": F.try_divide("right", "known")})
    return rows.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
