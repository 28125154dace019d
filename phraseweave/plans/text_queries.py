"""Registered queries of sentences, links, markup and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from phraseweave.functions import text as T
from phraseweave.functions import uri as U
from phraseweave.operators import pattern
from phraseweave.plans import synth
from phraseweave.plans.registry import query, whole
from phraseweave.session import spread
from phraseweave.sources import articles


@query(f"WITH {synth.PARSES} SELECT sentence_id, head AS a, idx AS b, deprel || '>' AS step FROM parse WHERE head <> 0 UNION ALL SELECT sentence_id, idx, head, deprel || '<' FROM parse WHERE head <> 0")
def parse_edges(spark, d):
    return pattern.edges_of(synth.parses(synth.short_sentences(spark, d))).select("sentence_id", whole("a", "a"), whole("b", "b"), "step")


@query(f"WITH {synth.SENTENCES} SELECT sentence_id, array_to_string(words, ' ') || ' ' AS text FROM sentences")
def sentence_strings(spark, d):
    return synth.sentences(spark, d).select("sentence_id", T.as_string(T.tagged(F.col("words"), F.array().cast("array<struct<address: string, words: array<string>>>"))).alias("text"))


@query(f"WITH {synth.SENTENCES} SELECT sentence_id FROM sentences WHERE contains(sentence, 'the of') OR contains(sentence, 'ung d')")
def anchor_sentences(spark, d):
    return synth.sentences(spark, d).filter(T.contains_anchor_text(F.col("sentence"), F.array(F.lit("the of"), F.lit("ung d")))).select("sentence_id")


@query(f"WITH {synth.SENTENCES} SELECT sentence_id, list_contains(words, 'and') OR list_contains(words, 'the') AS linked, list_contains(words, 'and') AS wanted FROM sentences")
def linked_sentences(spark, d):
    links = F.array(*(F.struct(F.lit(f"/wiki/{w}").alias("address"), F.array(F.lit(w)).alias("words")) for w in ("the", "and")))
    tokens = synth.sentences(spark, d).select("sentence_id", T.tagged(F.col("words"), links).alias("tokens"))
    return tokens.select("sentence_id", T.contains_any_link(F.col("tokens")).alias("linked"), T.contains_any_link(F.col("tokens"), F.array(F.lit("/wiki/and"), F.lit("/wiki/x"))).alias("wanted"))


@query(
    f"WITH {synth.SENTENCES}, t AS (SELECT sentence_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM sentences) SELECT sentence_id, 'http://dbpedia.org/resource/' || w AS link, string_agg(i, ',' ORDER BY i) AS addresses FROM t WHERE w IN ('the', 'and') GROUP BY ALL"
)
def resource_addresses(spark, d):
    links = F.array(*(F.struct(F.lit(f"/wiki/{w}").alias("address"), F.array(F.lit(w)).alias("words")) for w in ("the", "and")))
    tokens = synth.sentences(spark, d).select("sentence_id", F.inline(T.link_addresses(T.tagged(F.col("words"), links), resource=True)))
    return tokens.select("sentence_id", "link", F.array_join(F.transform("addresses", lambda i: i.cast("string")), ",").alias("addresses"))


@query("SELECT p_partkey, 'http://en.wikipedia.org/wiki/Part_' || p_partkey AS article, CASE WHEN p_partkey % 3 = 0 THEN 'Other ' || p_partkey ELSE p_name END AS name, try_cast(CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS BIGINT) IS NOT NULL AS number FROM part")
def article_names(spark, d):
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Other "), "p_partkey"))
    resource = F.concat(F.lit(f"{U.RESOURCE}Part_"), "p_partkey")
    number = U.is_number(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")))
    return synth.table(spark, d, "part").select("p_partkey", U.article_url(resource).alias("article"), U.redirected(F.col("p_name"), target).alias("name"), number.alias("number"))


@query("SELECT p_partkey, 'a' || p_brand || 'b}c' AS text FROM part")
def stripped_braces(spark, d):
    text = F.concat(F.lit("a{"), "p_name", F.lit("{x}{{y}}}"), "p_brand", F.lit("b}c{never closed "), "p_type")
    return synth.table(spark, d, "part").select("p_partkey", T.without_braces(text).alias("text"))


BAD = "['==', '{', '}', '[', ']', '<ref>', '<ref ', '</ref>', chr(13), '<!--', '-->', '''''']"


@query(f"SELECT page_id, array_to_string(list_filter({BAD}, lambda x: contains(coalesce(html, ''), x)), ' ') AS found FROM pages")
def residual_markup(spark, d):
    return synth.table(spark, d, "pages").select("page_id", F.array_join(T.residual_markup(F.coalesce("html", F.lit(""))), " ").alias("found"))


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS consistent FROM part")
def markup_consistency_escaped(spark, d):
    text = F.concat(F.lit("[["), "p_name", F.lit("]] {x} <nowiki>["), F.when(F.col("p_partkey") % 3 == 0, F.lit("[")).otherwise(""), F.lit("</nowiki>"), F.when(F.col("p_partkey") % 3 == 1, F.lit("]")).otherwise(""))
    return synth.table(spark, d, "part").select("p_partkey", T.markup_consistent(text, without_escaped=True).alias("consistent"))


@query("SELECT p_partkey, '<a href=\"/wiki/' || CASE WHEN p_partkey % 3 = 0 THEN 'Target_' || p_partkey ELSE 'Part_' || p_partkey END || '\">x</a>' AS html FROM part")
def redirect_html(spark, d):
    part = synth.table(spark, d, "part")
    html = F.concat(F.lit('<a href="/wiki/Part_'), "p_partkey", F.lit('">x</a>'))
    redirects = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("Part "), "p_partkey").alias("src"), F.concat(F.lit("Target "), "p_partkey").alias("dst"))
    return articles.redirect_links(part.select("p_partkey", html.alias("html")), redirects, column="html", html=True)


@query(
    "SELECT p_partkey, chr(10) || chr(10) || '<p>' || p_name || ' is by <a href=\"/wiki/Made_by_' || p_size || '\">' || p_brand || '</a> and<a href=\"/wiki/' || replace(p_type, ' ', '_') || '\">' || p_type || '</a>.</p>'"
    " || chr(10) || chr(10) || '<p>' || CASE WHEN p_partkey % 2 = 0 THEN 'two' ELSE 'x' || chr(10) || 'two' END || '</p>last ' || chr(10) AS html FROM part"
)
def markup_steps(spark, d):
    """Articles in which every step of the conversion has something to do."""
    pieces = [
        F.lit("{{Box|{{x}}}}= Part =\n'''"), "p_name", F.lit("''' is by<ref name=\"a\"/> [[Made by "), "p_size", F.lit("|"), "p_brand", F.lit("]]<!-- hidden\n\n --> and* [["), "p_type", F.lit("]].<Ref>note [[z]]</Ref>\n\n[[Category:Parts]]"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.lit("[x]\n")), F.lit("two[[File:a.jpg|thumb|of [[b]] and [c]]]\n\nlast [http://x y]\n== References ==\ngone"),
    ]
    return synth.table(spark, d, "part").select("p_partkey", T.html_of_wikitext(F.concat(*(F.col(c).cast("string") if isinstance(c, str) else c for c in pieces))).alias("html"))


@query(
    "SELECT p_partkey, unnest([0, 1]) AS paragraph, unnest([p_name || ' & ' || p_brand, 'two']) AS text, unnest(['/wiki/' || p_partkey || '=' || p_brand, '']) AS anchors FROM part"
)
def html_paragraphs_made(spark, d):
    html = F.concat(F.lit("before<p>"), "p_name", F.lit(" &amp; <a href='/wiki/"), "p_partkey", F.lit("'>"), "p_brand", F.lit("</a><p><b>two</b><a name='x'></a></p>behind<a href='/wiki/no'>no</a>"))
    part = spread(synth.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"))
    parts = part.select("p_partkey", F.posexplode(T.paragraphs_of_html(html)).alias("paragraph", "part"))
    anchors = F.array_join(F.transform("part.anchors", lambda a: F.concat(a["href"], F.lit("="), a["text"])), ",")
    return parts.select("p_partkey", "paragraph", "part.text", anchors.alias("anchors"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name || '''s ' || p_brand || ', ' || p_type || ' 3.5_x!', '[A-Za-z]+(?:[''-][A-Za-z]+)*|[0-9]+(?:[.,:/-][0-9]+)*|[^\\w\\s]|_'), ' ') AS tokens FROM part")
def word_tokens(spark, d):
    text = F.concat("p_name", F.lit("'s "), "p_brand", F.lit(", "), "p_type", F.lit(" 3.5_x!"))
    return synth.table(spark, d, "part").select("p_partkey", F.array_join(T.treebank_tokens(text), " ").alias("tokens"))


@query(
    "SELECT 'http://dbpedia.org/resource/Part_' || p_partkey AS s, unnest([0, 1]) AS paragraph, unnest([0, 1]) AS sentence, unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS relative_position,"
    " unnest(['The ' || p_name || ' is by [' || p_brand || ']', 'Then [' || p_brand || '] and ' || p_type]) AS tokens FROM part"
)
def tagged_articles(spark, d):
    """Sentences of articles with their linked tokens in brackets; sentences without any are left out."""
    link = F.concat(F.lit("<a href='/wiki/b'>"), "p_brand", F.lit("</a>"))
    html = F.concat(F.lit("<p>The "), "p_name", F.lit(" is by "), link, F.lit("\nNo link é here. x</p><p>Nothing. Then "), link, F.lit(" and "), "p_type", F.lit("</p>"))
    subjects = synth.table(spark, d, "part").select(F.concat(F.lit(f"{U.RESOURCE}Part_"), "p_partkey").alias("s"), html.alias("html"))
    tagged = articles.tag_sentences(subjects, tokenize=lambda texts: F.transform(texts, T.tokens))
    shown = F.array_join(F.transform("tokens", lambda t: F.when(t["link"] == "/wiki/b", F.concat(F.lit("["), t["text"], F.lit("]"))).otherwise(t["text"])), " ")
    return tagged.select("s", "paragraph", "sentence", "relative_position", shown.alias("tokens"))


@query("SELECT 'Part ' || p_partkey AS title, p_partkey % 2 = 0 AS consistent, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ']' END || CASE WHEN p_partkey % 3 = 0 THEN '-->' ELSE '' END AS residues FROM part")
def article_warnings(spark, d):
    text = F.concat(F.lit("{x}" + 3 * "'"), "p_name", F.lit(3 * "'"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("]"), F.when(F.col("p_partkey") % 3 == 0, " -->").otherwise(""))
    pages = synth.table(spark, d, "part").select(F.concat(F.lit("Part "), "p_partkey").alias("title"), text.alias("wikitext"))
    return articles.article_warnings(pages).select("title", "consistent", F.array_join("residues", "").alias("residues"))
