"""The jobs: learn relations and types from facts and articles, extract facts from other articles, judge them.

A job is a chain of the operators under a ``Config``; what one learns is a dictionary of tables that a
``Store`` keeps for the next. Articles come as (s, html), parses from a function that adds heads and
labels to rows with words, so any provider fits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseweave.config import Config
from phraseweave.functions import text as T
from phraseweave.functions.uri import clean_name, internal_link, resource_uri
from phraseweave.operators import facts as facts_of
from phraseweave.operators import pattern, types
from phraseweave.session import stored
from phraseweave.sources import rdf
from phraseweave.sources.articles import articles_of, fetched, tag_sentences

#: Adds heads array<int> (from 1; 0: the top) and labels array<string> to rows with words array<string>.
Parser = Callable[[DataFrame], DataFrame]
Tokenizer = Callable[[Column], Column]
#: Gives (s, html) of subjects (s).
Source = Callable[[DataFrame], DataFrame]


def article_source(config: Config, pages: DataFrame | None = None, fetch: Callable[[str], str] | None = None, redirects: DataFrame | None = None) -> Source:
    """Articles from a dump's pages (title, wikitext) or from a function of their address, as the configuration says; with redirects replaced if it says so."""
    from phraseweave.sources.articles import redirect_links

    if config.use_dump and pages is None or not config.use_dump and fetch is None:
        raise ValueError("pages are needed for a dump, a fetch function otherwise")
    source: Source = (lambda subjects: articles_of(subjects, pages)) if config.use_dump else (lambda subjects: fetched(subjects, fetch))
    if config.replace_redirects and redirects is not None:
        return lambda subjects: redirect_links(source(subjects), redirects, column="html", html=True)
    return source


def linked_objects(tagged: DataFrame, parser: Parser, max_tokens: int = 50) -> DataFrame:
    """A row for each link of each tagged sentence of 1 to ``max_tokens`` tokens.

    pattern_id, s, link, relative_position, sentence, words, heads, labels, start (the link's head token).
    """
    short = tagged.filter(F.size("tokens").between(1, max_tokens)).withColumn("words", F.transform("tokens", lambda t: t["text"]))
    parsed = parser(short).withColumn("links", T.link_addresses(F.col("tokens")))
    rows = parsed.select("s", "relative_position", T.as_string(F.col("tokens")).alias("sentence"), "words", "heads", "labels", F.inline("links"))
    rows = rows.withColumn("start", pattern.main_address(F.col("heads"), F.col("labels"), F.col("addresses"))).drop("addresses")
    return stored(rows.withColumn("pattern_id", F.monotonically_increasing_id()))


def of_relations(objects: DataFrame, relation_of: DataFrame | None) -> DataFrame:
    """Objects with the relations that they stand for (pattern_id, relation); None: they have a relation already."""
    return objects if relation_of is None else objects.join(relation_of, "pattern_id")


def object_types(objects: DataFrame, relation_of: DataFrame | None, entity_type: DataFrame) -> DataFrame:
    """(relation, side, type, n): types of both ends of the sentences that stand for each relation."""
    ends = F.array(*(F.struct(F.lit(side).alias("side"), clean_name(F.col(c)).alias("entity")) for side, c in (("subject", "s"), ("object", "link"))))
    per_entity = of_relations(objects, relation_of).select("relation", F.inline(ends)).groupBy("relation", "side", "entity").agg(F.count("*").alias("n"))
    return pattern.merge_types(per_entity.join(entity_type, "entity"))


def learn_patterns(objects: DataFrame, relation_of: DataFrame | None, entity_type: DataFrame, config: Config) -> dict[str, DataFrame]:
    """What the sentences of each relation (pattern_id, relation; a fact that repeats counts again; None: objects have their relation) have in common."""
    return {
        "pattern_word": pattern.clean_words(stored(pattern.merged(of_relations(objects, relation_of), config.depth)), config.least_threshold_words),
        "pattern_type": pattern.clean_types(object_types(objects, relation_of, entity_type), config.least_threshold_types),
        "pattern_meta": pattern.merge_meta(of_relations(objects, relation_of).select("relation", "relative_position")),
    }


def learn_types(facts: DataFrame, entity_type: DataFrame, config: Config) -> dict[str, DataFrame]:
    weights, probabilities = types.learn_types(rdf.first_by_line(facts, config.type_facts_limit), entity_type, config.subject_minimum, config.object_minimum)
    return {"type_pattern": weights, "type_pattern_type": probabilities}


def learn(facts: DataFrame, source: Source, entity_type: DataFrame, parser: Parser, config: Config, test_subjects: DataFrame, tokenize: Tokenizer = T.treebank_of_each) -> dict[str, DataFrame]:
    """All tables that extraction reads, learnt from facts (line_no, s, p, o) and the articles of their subjects, none of a test subject."""
    training = stored(rdf.training_facts(facts, test_subjects, config.relations(), config.relation_types_limit, config.facts_limit).withColumn("link", internal_link(F.col("o"))))
    sought = training.groupBy("s").agg(F.collect_set("link").alias("sought"))
    articles = source(sought.select("s")).join(sought, "s")
    objects = linked_objects(tag_sentences(articles, tokenize, sought="sought"), parser, config.max_tokens)
    relation_of = objects.select("pattern_id", "s", "link").join(training.select("s", "link", F.col("p").alias("relation")), ["s", "link"]).select("pattern_id", "relation")
    learnt = learn_patterns(objects, stored(relation_of), entity_type, config) | learn_types(facts, entity_type, config)
    return learnt | {"training_resource": training.select("s").distinct()}


def end_scores(learnt: Mapping[str, DataFrame], entity_type: DataFrame, config: Config, side: str) -> DataFrame:
    """(entity, scores) of entities with types: the relations that know one of them (without type matching all) and how well they fit that side, as (relation, score)."""
    found = learnt["type_pattern_type"].filter(F.col("side") == side).select(F.col("p").alias("relation"), "type", "probability")
    knows = learnt["pattern_type"].filter(F.col("side") == side).select("relation", "type").distinct().withColumn("knows", F.lit(True))
    of_type = found.join(knows, ["relation", "type"], "full")
    entities = entity_type.groupBy("entity").agg(F.collect_set("type").alias("types"))
    rows = entities.select("entity", F.size("types").alias("n"), F.explode("types").alias("type")).join(of_type, "type", "left")
    fits = rows.groupBy("entity", "n", "relation").agg((F.coalesce(F.sum("probability"), F.lit(0.0)) / F.col("n")).alias("score"), F.max("knows").alias("knows"))
    wanted = F.col("relation").isNotNull() & (F.col("knows") if config.type_matching else F.lit(True))
    return fits.groupBy("entity").agg(F.collect_list(F.when(wanted, F.struct("relation", "score"))).alias("scores"))


def score_objects(objects: DataFrame, learnt: Mapping[str, DataFrame], entity_type: DataFrame, config: Config, keep: Sequence[str] = ("sentence",)) -> DataFrame:
    """Facts (pattern_id, s, p, o, kept columns, its scores and score) of linked objects whose match reaches the threshold.

    Candidates of an object are the relations that know types of both ends. What its tree has in common with
    relations is counted where the tree is; then scores come to each end by its entity, once for all relations.
    """
    parts = pattern.common_sums(objects, learnt["pattern_word"], list(dict.fromkeys(["pattern_id", "s", "link", "relative_position", *keep])), config.depth)
    parts = parts.withColumns({"subject": clean_name(F.col("s")), "object": clean_name(F.col("link"))})
    for side in types.SIDES:
        scores = end_scores(learnt, entity_type, config, side)
        parts = parts.join(scores.withColumnsRenamed({"entity": side, "scores": f"{side}_scores"}), side, "left")
    parts = parts.drop(*types.SIDES).withColumn("o", resource_uri(F.col("link")))
    weights = learnt["type_pattern"].select(F.col("p").alias("relation"), "subject_weight", "object_weight")
    return facts_of.scored_objects(parts, learnt["pattern_word"], learnt["pattern_meta"], weights, config.match_threshold, config.position_weight, config.syntax_weight, config.type_matching, config.allow_unknown_entity_types, keep)


def extract(learnt: Mapping[str, DataFrame], facts: DataFrame, source: Source, entity_type: DataFrame, parser: Parser, config: Config, tokenize: Tokenizer = T.treebank_of_each) -> DataFrame:
    """Facts found in the articles of subjects of ``facts`` that weren't learnt from."""
    known_types = learnt["pattern_type"].filter("side = 'subject'")
    subjects = facts_of.discovery_entities(facts, learnt["training_resource"], entity_type, known_types, config.articles_limit, config.allow_unknown_entity_types)
    return extract_from(source(subjects.select("s")), learnt, entity_type, parser, config, tokenize)


def extract_from(articles: DataFrame, learnt: Mapping[str, DataFrame], entity_type: DataFrame, parser: Parser, config: Config, tokenize: Tokenizer = T.treebank_of_each) -> DataFrame:
    """Facts found in articles (s, html)."""
    return score_objects(linked_objects(tag_sentences(articles, tokenize), parser, config.max_tokens), learnt, entity_type, config)


def evaluate(learnt: Mapping[str, DataFrame], truth: DataFrame, source: Source, entity_type: DataFrame, parser: Parser, config: Config, tokenize: Tokenizer = T.treebank_of_each) -> DataFrame:
    """Precision, recall and F of extraction on the subjects of true facts (line_no, s, p, o) that weren't learnt from, for each learnt relation."""
    relations = learnt["pattern_meta"].select(F.col("relation").alias("p"))
    fresh = truth.join(learnt["training_resource"], "s", "left_anti").join(relations, "p", "left_semi")
    test = stored(rdf.test_facts(fresh, config.test_facts_limit))
    found = extract_from(source(test.select("s").distinct()), learnt, entity_type, parser, config, tokenize)
    return facts_of.evaluation(found, test)
