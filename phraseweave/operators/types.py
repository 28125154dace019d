"""Type distributions of relations, entity types and their hierarchy, and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseweave.functions.uri import clean_name
from phraseweave.session import stored

SIDES = {"subject": "s", "object": "o"}


def sides(facts: DataFrame) -> DataFrame:
    """(p, side, entity): two rows for each fact, entities by clean name."""
    both = F.array(*(F.struct(F.lit(side).alias("side"), clean_name(F.col(c)).alias("entity")) for side, c in SIDES.items()))
    return facts.select("p", F.inline(both))


def predicate_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("p").agg(F.count("*").alias("facts"))


def relation_histogram(facts: DataFrame) -> DataFrame:
    return predicate_counts(facts).orderBy(F.desc("facts"), "p")


def type_counts(facts: DataFrame, entity_type: DataFrame) -> DataFrame:
    """(p, side, type, n): facts whose entity on that side has the type.

    Facts are counted by entity before the join, so an entity with very many facts is one row in it.
    """
    per_entity = sides(facts).groupBy("p", "side", "entity").agg(F.count("*").alias("facts"))
    return per_entity.join(entity_type, "entity").groupBy("p", "side", "type").agg(F.sum("facts").alias("n"))


def type_threshold(counts: DataFrame, predicates: DataFrame, subject_minimum: float, object_minimum: float) -> DataFrame:
    """Counts that reach the minimum of their side: a share of the facts if it is below 1, a number otherwise."""
    least = F.when(F.col("side") == "subject", F.lit(subject_minimum)).otherwise(F.lit(object_minimum))
    bound = F.when((least > 0) & (least < 1), least * F.col("facts")).otherwise(least)
    return counts.join(predicates, "p").filter(F.col("n") >= bound).select("p", "side", "type", "n", "facts")


def type_probability(kept: DataFrame) -> DataFrame:
    """How likely a relation is given a type: its rate among the relation's facts over the sum of all relations' rates."""
    rate = F.col("n") / F.col("facts")
    return kept.withColumn("probability", rate / F.sum(rate).over(Window.partitionBy("side", "type")))


def type_weights(kept: DataFrame, predicates: DataFrame) -> DataFrame:
    """(p, facts, subject_weight, object_weight): probabilities weighted by counts; 0 without types."""
    weighted = type_probability(kept).groupBy("p").agg(
        *(F.try_divide(F.sum(F.when(F.col("side") == side, F.col("n") * F.col("probability"))), F.sum(F.when(F.col("side") == side, F.col("n")))).alias(f"{side}_weight") for side in SIDES)
    )
    return predicates.join(weighted, "p", "left").select("p", "facts", *(F.coalesce(f"{side}_weight", F.lit(0.0)).alias(f"{side}_weight") for side in SIDES))


def learn_types(facts: DataFrame, entity_type: DataFrame, subject_minimum: float = 0.05, object_minimum: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The two tables of a type store: of relations, and of their types."""
    predicates = predicate_counts(facts)
    kept = type_threshold(type_counts(facts, entity_type), predicates, subject_minimum, object_minimum)
    return type_weights(kept, predicates), type_probability(kept).drop("facts")


def best_types(probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """For each relation the likeliest type of either side (ties: the smaller name; none: empty and 0) and the mean weight."""
    order = Window.partitionBy("p", "side").orderBy(F.desc("probability"), "type")
    first = probabilities.withColumn("n_th", F.row_number().over(order)).filter("n_th = 1")
    wide = first.groupBy("p").agg(*(F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for side in SIDES for c in ("type", "probability")))
    filled = [F.coalesce(f"{side}_{c}", F.lit("" if c == "type" else 0.0)).alias(f"{side}_{c}") for side in SIDES for c in ("type", "probability")]
    return weights.join(wide, "p", "left").select("p", *filled, ((F.col("subject_weight") + F.col("object_weight")) / 2).alias("mean_weight"))


def united_types(driving: DataFrame, other: DataFrame, all_entities: bool = False) -> DataFrame:
    """Types of both sources for the entities of the driving one (or of both)."""
    more = other if all_entities else other.join(driving.select("entity").distinct(), "entity", "left_semi")
    return driving.unionByName(more).distinct()


def ancestors(inheritance: DataFrame) -> DataFrame:
    """(type, ancestor) with each type its own ancestor, until no level adds a pair; cycles end there too."""
    step = inheritance.select("type", "parent")
    reached = step.select("type").union(step.select("parent")).distinct().withColumn("ancestor", F.col("type"))
    found = reached
    while True:
        up = step.select(F.col("type").alias("ancestor"), "parent")
        further = reached.join(up, "ancestor").select("type", F.col("parent").alias("ancestor")).distinct()
        reached = stored(further.join(found, ["type", "ancestor"], "left_anti"))
        if not reached.limit(1).count():
            return found
        found = stored(found.union(reached))


def total_facts(predicates: DataFrame) -> DataFrame:
    return predicates.agg(F.sum("facts").alias("facts"))


def types_of(entities: DataFrame, entity_type: DataFrame) -> DataFrame:
    """(entity, types) of each distinct entity: its types, sorted; none: an empty array."""
    known = entities.select("entity").distinct().join(entity_type.distinct(), "entity", "left")
    return known.groupBy("entity").agg(F.array_sort(F.collect_set("type")).alias("types"))


def transitive_counts(counts: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(p, side, type, n) with every count added to all ancestors of its type."""
    up = counts.join(ancestors(inheritance), "type", "left").withColumn("ancestor", F.coalesce("ancestor", "type"))
    return up.groupBy("p", "side", F.col("ancestor").alias("type")).agg(F.sum("n").alias("n"))


def type_count_statistics(facts: DataFrame, entity_type: DataFrame, outlier: int = 100) -> DataFrame:
    """One row: how many types the entities of facts have by side (number, mean, sample deviation below the outlier), and how many facts have types on both, one or no side."""
    per_entity = entity_type.groupBy("entity").agg(F.count("*").alias("types"))
    counted = facts.select("line_no", clean_name(F.col("s")).alias("s"), clean_name(F.col("o")).alias("o"))
    for c in ("s", "o"):
        counted = counted.join(per_entity.select(F.col("entity").alias(c), F.col("types").alias(f"{c}_types")), c, "left")
    kept = {c: F.when(F.col(f"{c}_types") < outlier, F.col(f"{c}_types")) for c in ("s", "o")}
    has_s, has_o = F.col("s_types").isNotNull(), F.col("o_types").isNotNull()
    return counted.agg(
        *(f(kept[c]).alias(f"{side}_{name}") for side, c in SIDES.items() for name, f in (("n", F.count), ("mean", F.avg), ("deviation", F.stddev_samp))),
        F.count_if(has_s & has_o).alias("both"), F.count_if(has_s != has_o).alias("one"), F.count_if(~has_s & ~has_o).alias("neither"),
    )


def specificity(counts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(p, subject, object): how far a relation's types are from their shares among all other facts, weighted by count; -1 without types."""
    total = predicates.agg(F.sum("facts").alias("total"))
    rows = counts.join(predicates, "p").crossJoin(F.broadcast(total))  # one row
    everywhere = F.sum("n").over(Window.partitionBy("side", "type"))
    apart = F.abs(F.col("n") / F.col("facts") - (everywhere - F.col("n")) / F.col("total"))
    scored = rows.withColumn("apart", apart).groupBy("p").pivot("side", list(SIDES)).agg(F.sum(F.col("n") * F.col("apart")) / F.sum("n"))
    return scored.select("p", *(F.coalesce(side, F.lit(-1.0)).alias(side) for side in SIDES))


def independence(facts: DataFrame, entity_type: DataFrame, threshold: float = 1.0, mark_untyped: bool = False) -> DataFrame:
    """(p, facts, score): how far observed pairs of subject and object type are from independent ones, over pairs expected ``threshold`` times or more; null if there are none.

    ``mark_untyped`` gives subjects without types the type #empty.
    """
    # an entity's types are one row in the joins, and all counts are sums over one reading of the facts
    of = {c: entity_type.groupBy(F.col("entity").alias(c)).agg(F.collect_list(F.struct(F.coalesce("type", F.lit("#empty") if c == "s" else F.lit(None)).alias("type"))).alias(f"{c}_types")) for c in ("s", "o")}
    rows = facts.select("p", clean_name(F.col("s")).alias("s"), clean_name(F.col("o")).alias("o")).join(of["s"], "s", "left").join(of["o"], "o", "left")
    untyped = F.array(F.struct(F.lit("#empty").alias("type"))) if mark_untyped else F.array().cast("array<struct<type: string>>")
    s_types, o_types = F.coalesce("s_types", untyped), F.coalesce("o_types", F.array().cast("array<struct<type: string>>"))
    count = lambda what, s, o: F.struct(F.lit(what).alias("what"), s.alias("s_type"), o.alias("o_type"))
    none = F.lit(None).cast("string")
    both = F.flatten(F.transform(s_types, lambda s: F.transform(o_types, lambda o: count("both", s["type"], o["type"]))))
    each = F.concat(F.array(count("fact", none, none)), F.transform(s_types, lambda s: count("s", s["type"], none)), F.transform(o_types, lambda o: count("o", none, o["type"])), both)
    counts = stored(rows.select("p", F.inline(each)).groupBy("p", "what", "s_type", "o_type").agg(F.count("*").alias("n")))
    of_what = lambda what, n, *keys: counts.filter(F.col("what") == what).select("p", *keys, F.col("n").alias(n))
    predicates = of_what("fact", "facts")
    rows = of_what("both", "observed", "s_type", "o_type").join(of_what("s", "s_n", "s_type"), ["p", "s_type"]).join(of_what("o", "o_n", "o_type"), ["p", "o_type"]).join(predicates, "p")
    expected = F.col("s_n") * F.col("o_n") / F.col("facts")
    rows = rows.withColumn("expected", expected).filter(F.col("expected") >= threshold)
    scored = rows.groupBy("p").agg((F.sum(F.col("observed") * F.abs(F.col("observed") - F.col("expected")) / F.col("expected")) / F.sum("observed")).alias("score"))
    return predicates.join(scored, "p", "left").select("p", "facts", "score")


def independence_table(scores: DataFrame) -> DataFrame:
    """(p, facts, score) as a report has them: the most dependent relations first, those without a score last."""
    return scores.orderBy(F.desc_nulls_last("score"), F.desc("facts"), "p")


def overall_independence(scores: DataFrame) -> DataFrame:
    return scores.filter("score is not null").agg(F.try_divide(F.sum(F.col("facts") * F.col("score")), F.sum("facts")).alias("score"))
