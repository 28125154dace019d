"""Registered queries of sources, sinks, stores, limits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from phraseweave.config import Config
from phraseweave.functions import uri as U
from phraseweave.operators import facts as facts_of
from phraseweave.operators import match, reports, types
from phraseweave.plans import jobs, synth
from phraseweave.plans.registry import query, r6
from phraseweave.session import scratch_folder
from phraseweave.sources import articles, rdf, tables

CLEAN_S, CLEAN_O = ("replace(split_part({}, '/', -1), '_', ' ')".format(c) for c in "so")


@query(f"WITH {synth.FACTS} SELECT s, p, o FROM facts")
def triples_file(spark, d):
    path = scratch_folder(spark, "triples")
    rdf.write_triples(synth.facts(spark, d), path)
    return rdf.scan_triples(spark, path).select("s", "p", "o")


@query("SELECT count(*) AS lines FROM lineitem")
def line_count(spark, d):
    path = scratch_folder(spark, "lines")
    rdf.write_triples(synth.facts(spark, d), path)
    return spark.createDataFrame([(rdf.line_count(spark, path),)], "lines long")


@query(f"WITH {synth.FACTS} SELECT line_no, {CLEAN_S} AS s, replace(split_part(p, '/', -1), '_', ' ') AS p, {CLEAN_O} AS o FROM facts")
def cleaned_names(spark, d):
    return rdf.cleaned_names(synth.facts(spark, d)).select("line_no", "s", "p", "o")


@query(f"WITH {synth.FACTS} SELECT line_no, s, p, o FROM facts WHERE line_no > (SELECT trunc(max(line_no) / 2 * 0.25) FROM facts)")
def facts_from_share(spark, d):
    return rdf.from_share(synth.facts(spark, d), 0.25).select("line_no", "s", "p", "o")


@query(f"WITH {synth.FACTS} SELECT line_no, s, p, o FROM facts ORDER BY line_no LIMIT 500")
def facts_first(spark, d):
    return rdf.first_by_line(synth.facts(spark, d), 500).select("line_no", "s", "p", "o")


@query(f"WITH {synth.FACTS} SELECT line_no, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY line_no) AS n FROM facts WHERE known) WHERE n <= 30")
def facts_for_tests(spark, d):
    return rdf.test_facts(synth.facts(spark, d).filter("known"), 30).select("line_no", "s", "p", "o")


@query(f"WITH {synth.FACTS} SELECT {CLEAN_S} AS entity, {CLEAN_O} AS type FROM facts WHERE p IN ('{synth.KB}ontology/URGENT', '{synth.KB}ontology/HIGH')")
def clean_assertions(spark, d):
    return rdf.clean_assertions(synth.facts(spark, d), [f"{synth.KB}ontology/{n}" for n in ("URGENT", "HIGH")])


@query(f"WITH {synth.FACTS}, a AS (SELECT {CLEAN_S} AS entity, 'Y' || {CLEAN_O} AS type FROM facts WHERE known), b AS (SELECT {CLEAN_O} AS entity, {CLEAN_S} AS type FROM facts WHERE line_no % 3 = 0 UNION ALL SELECT {CLEAN_S}, 'owlThing' FROM facts WHERE line_no % 3 = 1) FROM a UNION FROM b WHERE entity IN (SELECT entity FROM a)")
def types_job(spark, d):
    """Assertions as triples are cleaned, written and read as delimited tables, and joined to one."""
    f, folder = synth.facts(spark, d), scratch_folder(spark, "types")
    is_a = F.lit("http://x.example/is_a").alias("p")
    one = f.filter("known").select("s", is_a, F.concat(F.lit("http://x.example/Yago"), U.local_name(F.col("o"))).alias("o"))
    two = f.filter("line_no % 3 = 0").select(F.col("o").alias("s"), is_a, F.col("s").alias("o")).union(f.filter("line_no % 3 = 1").select("s", is_a, F.lit("http://x.example/owl#Thing")))
    for name, triples in (("one", one), ("two", two)):
        rdf.write_triples(triples, f"{folder}/{name}.nt")
        tables.write_delimited(rdf.clean_assertions(rdf.scan_triples(spark, f"{folder}/{name}.nt"), ["http://x.example/is_a"], complain=True), f"{folder}/{name}.csv")
    return types.united_types(tables.read_types(spark, f"{folder}/one.csv"), tables.read_types(spark, f"{folder}/two.csv"))


@query(f"WITH {synth.ENTITY_TYPE} SELECT entity, replace(type, '#', '-') AS type FROM entity_type")
def types_csv(spark, d):
    path = scratch_folder(spark, "types")
    tables.write_delimited(synth.entity_type(spark, d).select("entity", F.translate("type", "#", "-").alias("type")), path)
    return tables.read_types(spark, path)


@query("SELECT n_name AS type, r_name || ' 2' AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'THING 2' FROM region")
def inheritance_csv(spark, d):
    path = scratch_folder(spark, "inheritance")
    lines = synth.inheritance(spark, d).select("type", "parent", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    lines = lines.select("type", F.concat_ws(" ", "parent", F.col("k").cast("string")).alias("parent"), "k")
    tables.write_delimited(lines.coalesce(1).sortWithinPartitions("k").select("type", "parent"), path)
    return tables.read_inheritance(spark, path)


def _index(spark, d):
    path = scratch_folder(spark, "index")
    part = synth.table(spark, d, "part")
    lines = part.select("p_partkey", F.concat(F.lit("Part "), "p_partkey").alias("entity"), F.concat_ws("_", F.translate("p_brand", "#", "-"), "p_type").alias("types"))
    tables.write_delimited(lines.coalesce(1).sortWithinPartitions("p_partkey").select("entity", "types"), path)
    return path


@query("SELECT 'Part ' || p_partkey AS entity, unnest([replace(p_brand, '#', '-'), p_type]) AS type FROM part")
def types_index(spark, d):
    return tables.read_types_index(spark, _index(spark, d))


@query("SELECT 'Part ' || p_partkey AS entity, unnest([replace(p_brand, '#', '-'), p_type]) AS type FROM (FROM part ORDER BY p_partkey LIMIT 70)")
def types_index_limited(spark, d):
    return tables.read_types_index(spark, _index(spark, d), 70)


@query("SELECT 'Part & ' || p_partkey AS title, '<' || p_name || '> & [[' || p_brand || ']]' AS wikitext FROM part")
def dump_pages(spark, d):
    path = scratch_folder(spark, "dump")
    page = F.concat(F.lit("<page><title>Part &amp; "), "p_partkey", F.lit("</title><ns>0</ns><id>"), "p_partkey", F.lit('</id><revision><text xml:space="preserve">&lt;'), "p_name", F.lit("&gt; &amp; [["), "p_brand", F.lit("]]</text></revision></page>"))
    synth.table(spark, d, "part").select(page.alias("value")).write.mode("overwrite").text(path)
    return articles.read_dump(spark, path)


@query(f"WITH {synth.FACTS} SELECT DISTINCT o AS s, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<p>' || p_name || ' by <a href=\"/wiki/Made_of_' || p_size || '\">' || p_brand || '</a>.</p>' END AS html FROM facts JOIN part ON o = '{synth.KB}resource/Part_' || p_partkey")
def articles_of_subjects(spark, d):
    """Articles from a dump's pages; a subject without a page has an empty one."""
    markup = F.concat(F.lit("'''"), "p_name", F.lit("''' by [[Made of "), "p_size", F.lit("|"), "p_brand", F.lit("]].\n\n"))
    pages = synth.table(spark, d, "part").filter("p_partkey % 4 <> 0").select(F.concat(F.lit("Part "), "p_partkey").alias("title"), markup.alias("wikitext"))
    return jobs.article_source(Config(use_dump=True), pages=pages)(synth.facts(spark, d).select(F.col("o").alias("s")).distinct())


@query(f"WITH {synth.FACTS} SELECT DISTINCT replace(s, 'kb.example', 'dbpedia.org') AS s, 'http://en.wikipedia.org/wiki/' || split_part(s, '/', -1) AS html FROM facts")
def articles_fetched(spark, d):
    """Articles from a function of their address, which gives the address here."""
    subjects = synth.facts(spark, d).select(F.replace("s", F.lit("kb.example"), F.lit("dbpedia.org")).alias("s")).distinct()
    return jobs.article_source(Config(use_dump=False), fetch=str)(subjects)


BLOCK = "'# ' || p_name || chr(10) || p_brand"


@query(f"SELECT {BLOCK} AS value, count(*) AS n FROM part GROUP BY ALL")
def text_blocks(spark, d):
    path = scratch_folder(spark, "blocks")
    blocks = synth.table(spark, d, "part").select(F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_brand").alias("value"))
    blocks.write.mode("overwrite").option("lineSep", "\n\n").text(path)
    return articles.read_blocks(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT '[[' || CASE WHEN p_partkey % 2 = 1 THEN 'Target ' ELSE 'Part ' END || (p_partkey + 1) || '|x]] [[' || CASE WHEN p_partkey % 2 = 0 THEN 'Target ' || p_partkey || '|' ELSE '' END || 'Part ' || p_partkey || ']]' AS value, count(*) AS n FROM part GROUP BY ALL")
def rewritten_dump(spark, d):
    folder = scratch_folder(spark, "dump")
    part = synth.table(spark, d, "part")
    blocks = part.select(F.concat(F.lit("[[Part "), F.col("p_partkey") + 1, F.lit("|x]] [[Part "), "p_partkey", F.lit("]]")).alias("value"))
    every = part.select(F.explode(F.array("p_partkey", F.col("p_partkey") + 1)).alias("k")).distinct()
    redirects = every.filter("k % 2 = 0").select(F.concat(F.lit("Part_"), "k").alias("src"), F.concat(F.lit("Target "), "k").alias("dst"))
    blocks.write.mode("overwrite").option("lineSep", "\n\n").text(f"{folder}/before")
    articles.rewrite_dump(spark, f"{folder}/before", redirects, f"{folder}/after")
    return articles.read_blocks(spark, f"{folder}/after").groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {synth.KEPT} SELECT 'type_pattern' AS stored, count(*) AS n FROM weights UNION ALL SELECT 'type_pattern_type', count(*) FROM probs UNION ALL SELECT 'training_resource', count(DISTINCT s) FROM facts")
def store_tables(spark, d):
    f, folder = synth.facts(spark, d), scratch_folder(spark, "store")
    weights, probabilities = types.learn_types(f, synth.entity_type(spark, d))
    of_types, of_patterns = tables.TypeStore(spark, f"{folder}/types"), tables.PatternStore(spark, f"{folder}/patterns")
    of_types.save(type_pattern=weights, type_pattern_type=probabilities)
    of_patterns.save(training_resource=f.select("s").distinct())
    counted = [df.agg(F.lit(name).alias("stored"), F.count("*").alias("n")) for name, df in (*of_types.items(), ("training_resource", of_patterns.training_resource))]
    return counted[0].union(counted[1]).union(counted[2])


@query(f"WITH {synth.FACTS} SELECT s, p, o, line_no % 100 / 100 AS score, 'line ' || line_no AS sentence FROM facts")
def scored_file(spark, d):
    path = scratch_folder(spark, "scored")
    scored = synth.facts(spark, d).withColumns({"score": F.col("line_no") % 100 / 100, "sentence": F.concat(F.lit("line "), "line_no")})
    rdf.write_scored(scored, path)
    return spark.read.schema("s string, p string, o string, score double, sentence string").json(path)


@query(f"WITH {synth.FACTS} SELECT s, p, o, line_no % 100 / 100 AS score FROM facts ORDER BY score DESC, s, p, o LIMIT 200")
def facts_by_score(spark, d):
    scored = synth.facts(spark, d).withColumn("score", F.col("line_no") % 100 / 100)
    return facts_of.by_score(scored).limit(200).select("s", "p", "o", "score")


@query("SELECT 'Part ' || p_partkey AS title, p_partkey * 7 AS position FROM part")
def page_index(spark, d):
    path = scratch_folder(spark, "pages")
    tables.write_page_index(synth.table(spark, d, "part").select(F.concat(F.lit("Part "), "p_partkey").alias("title"), (F.col("p_partkey") * 7).alias("position")), path)
    return tables.read_page_index(spark, path)


@query(
    f"WITH {synth.FACTS}, {synth.ENTITY_TYPE}, predicates AS (SELECT p, count(*) AS facts FROM facts GROUP BY p), n AS (SELECT p, {CLEAN_S} AS s, {CLEAN_O} AS o FROM facts),"
    " l AS (SELECT p, o, type AS st FROM n JOIN entity_type ON entity = s), ob AS (SELECT p, st, type AS ot, count(*) AS obs FROM l JOIN entity_type ON entity = o GROUP BY ALL), sc AS (SELECT p, st, count(*) AS sn FROM l GROUP BY ALL),"
    " oc AS (SELECT p, type AS ot, count(*) AS onn FROM n JOIN entity_type ON entity = o GROUP BY ALL), x AS (SELECT p, obs, sn * onn / facts AS e FROM ob JOIN sc USING (p, st) JOIN oc USING (p, ot) JOIN predicates USING (p)),"
    " scores AS (SELECT p, predicates.facts, score FROM predicates LEFT JOIN (SELECT p, sum(obs * abs(obs - e) / e) / sum(obs) AS score FROM x WHERE e >= 1 GROUP BY p) USING (p))"
    " SELECT p, facts, round(score, 6) AS score, (SELECT round(sum(facts * score) / sum(facts), 6) FROM scores WHERE score IS NOT NULL) AS overall FROM scores"
)
def independence_csv(spark, d):
    path = scratch_folder(spark, "independence")
    scores = types.independence(synth.facts(spark, d), synth.entity_type(spark, d))
    tables.write_delimited(types.independence_table(scores).select("p", "facts", "score"), path, header=True)
    read = spark.read.csv(path, sep="#", header=True, schema="p string, facts long, score double")
    return read.crossJoin(F.broadcast(types.overall_independence(read).withColumnRenamed("score", "overall"))).select("p", "facts", r6("score", "score"), r6("overall", "overall"))  # one row


@query("SELECT count(*) AS facts FROM lineitem")
def total_facts(spark, d):
    return types.total_facts(types.predicate_counts(synth.facts(spark, d))).select(F.col("facts").cast("bigint").alias("facts"))


@query(f"WITH {synth.FACTS}, {synth.ENTITY_TYPE}, e AS (SELECT DISTINCT {CLEAN_O} AS entity FROM facts WHERE known UNION SELECT 'Nobody'), t AS (SELECT entity, array_to_string(list_sort(list(type)), ',') AS types FROM entity_type GROUP BY entity) SELECT entity, coalesce(types, '') AS types FROM e LEFT JOIN t USING (entity)")
def type_lookup(spark, d):
    known = synth.facts(spark, d).filter("known").select(U.clean_name(F.col("o")).alias("entity"))
    nobody = spark.createDataFrame([("Nobody",)], "entity string")
    return types.types_of(known.union(nobody), synth.entity_type(spark, d)).select("entity", F.array_join("types", ",").alias("types"))


@query(f"WITH {synth.KEPT}, e AS (SELECT DISTINCT {CLEAN_S} AS entity FROM facts), t AS (SELECT * FROM entity_type WHERE entity LIKE '%0') SELECT DISTINCT e.entity, k.p AS relation FROM e JOIN t USING (entity) JOIN kept k ON k.type = t.type AND k.side = 'subject' UNION ALL SELECT entity, p FROM e CROSS JOIN predicates WHERE entity NOT IN (SELECT entity FROM t)")
def untyped_candidates(spark, d):
    f = synth.facts(spark, d)
    predicates = types.predicate_counts(f)
    kept = types.type_threshold(types.type_counts(f, synth.entity_type(spark, d)), predicates, 0.05, 0.05).filter("side = 'subject'").withColumnRenamed("p", "relation")
    entities = f.select(U.clean_name(F.col("s")).alias("entity"))
    return match.candidate_relations(entities, synth.entity_type(spark, d).filter("entity like '%0'"), kept, predicates.withColumnRenamed("p", "relation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS score FROM lineitem")
def match_untyped(spark, d):
    score = match.match_score(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.5), F.col("l_quantity") / 50, F.lit(0.9), F.lit(0.6), type_matching=False)
    return synth.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


@query("SELECT true AS same, count(*) < 0 AS fewer FROM lineitem")
def same_facts(spark, d):
    f = synth.facts(spark, d)
    return spark.createDataFrame([(facts_of.same_facts(f, f.union(f)), facts_of.same_facts(f, f.filter("known")))], "same boolean, fewer boolean")


@query(
    f"WITH {synth.KEPT}, best AS (SELECT p, side, type FROM (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY round(probability, 9) DESC, type) AS nth FROM probs) WHERE nth = 1)"
    " SELECT w.p, w.p || ' | ' || coalesce(s.type, '') || ' | ' || coalesce(o.type, '') || ' | ' || printf('%.3f', round((subject_weight + object_weight) / 2, 9)) AS line FROM weights w LEFT JOIN best s ON s.p = w.p AND s.side = 'subject' LEFT JOIN best o ON o.p = w.p AND o.side = 'object'"
)
def type_report(spark, d):
    weights, probabilities = types.learn_types(synth.facts(spark, d), synth.entity_type(spark, d))
    best = types.best_types(probabilities.withColumn("probability", F.round("probability", 9)), weights)
    return reports.type_report(best.withColumn("mean_weight", F.round("mean_weight", 9)))


@query(
    f"WITH {synth.FACTS}, truth AS (SELECT DISTINCT s, p, o FROM facts WHERE known), k AS (SELECT p, count(*) AS known FROM truth GROUP BY p), e AS (SELECT f.p, t.s IS NOT NULL AS hit FROM facts f LEFT JOIN truth t ON t.s = f.s AND t.p = f.p AND t.o = f.o WHERE line_no % 3 = 0 AND f.p NOT LIKE '%LOW'), c AS (SELECT p, count_if(hit) AS r, count_if(NOT hit) AS w FROM e GROUP BY p),"
    " x AS (SELECT p, known, coalesce(r, 0) AS r, coalesce(w, 0) AS w, CASE WHEN r + w > 0 THEN r / (r + w) END AS precision, coalesce(r, 0) / known AS recall FROM k LEFT JOIN c USING (p))"
    " SELECT p, p || ' known: ' || known || ' right: ' || r || ' wrong: ' || w || ' precision: ' || coalesce(printf('%.3f', precision), '-') || ' recall: ' || printf('%.3f', recall) || ' f: ' || coalesce(printf('%.3f', 2 * precision * recall / (precision + recall)), '-') AS line FROM x"
)
def evaluation_report(spark, d):
    f = synth.facts(spark, d)
    return reports.evaluation_report(facts_of.evaluation(f.filter("line_no % 3 = 0 and p not like '%LOW'"), f.filter("known")))


@query(f"WITH {synth.FACTS}, l AS (SELECT DISTINCT line_no % 1000 AS sentence_id, s, '/wiki/' || split_part(o, '/', -1) AS link FROM facts WHERE known) SELECT DISTINCT f.s, f.p, f.o, l.sentence_id FROM facts f JOIN l ON l.s = f.s AND l.link = '/wiki/' || split_part(f.o, '/', -1)")
def occurrence_report(spark, d):
    f = synth.facts(spark, d)
    links = f.filter("known").select((F.col("line_no") % 1000).alias("sentence_id"), "s", U.internal_link(F.col("o")).alias("link"))
    return reports.occurrence_report(facts_of.occurrences(f, links))
