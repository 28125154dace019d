"""Golden cases of text, URI and markup functions, scans, sinks, stores and configuration."""

import math

import pytest
from pyspark.sql import functions as F

from phraseweave.config import Config
from phraseweave.functions import text as T
from phraseweave.functions import uri as U
from phraseweave.operators import facts as facts_of
from phraseweave.operators import match, pattern, types
from phraseweave.sources import articles, rdf, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(text):
    return F.array(*map(F.lit, text.split()))


@pytest.mark.parametrize(("needle", "hay", "n"), [("1 0 1 0", "1 0 1 1 0 1 0", 1), ("1 0 1 0", "1 0 1 0 1 0", 2), ("0 1 0 0", "0 1 0 1 0 0", 1)])
def test_token_matches(spark, needle, hay, n):
    assert one(spark, F.size(T.match_starts(words(hay), words(needle)))) == n


def test_covered_indexes_and_tags(spark):
    hay = words("Born Elinor Isabel Judefind in Baltimore , Maryland")
    assert one(spark, T.covered_indexes(hay, words("Baltimore , Maryland"))) == [5, 6, 7]
    assert one(spark, F.size(T.match_starts(hay, F.array().cast("array<string>")))) == 0
    links = F.array(F.struct(F.lit("/wiki/a").alias("address"), words("in Baltimore").alias("words")), F.struct(F.lit("/wiki/b").alias("address"), words("Baltimore").alias("words")))
    got = one(spark, T.tagged(hay, links))
    assert [t.link for t in got][4:6] == ["/wiki/a", "/wiki/b"] and one(spark, T.contained_links(T.tagged(hay, links))) == ["/wiki/a", "/wiki/b"]


def test_markup():
    assert T.strip_braces("ab{c{d}e}f}g") == "abf}g"
    assert T.wikitext_to_html("[[File:x.jpg|thumb|a [[b]] c <ref>[http://x y]</ref>]]") == ""
    html = T.wikitext_to_html("{{Infobox}}'''A''' is [[B c|see]] and [[D e]].<!-- no --><ref>x</ref>\n\n== Head ==\nLast\n\nnot a paragraph\n== References ==\nmore")
    assert html.startswith('<p>A is <a href="/wiki/B_c">see</a> and <a href="/wiki/D_e">D e</a>.</p>') and "Head" not in html and "more" not in html
    assert T.redirect_markup("[[A_b]] [[A b|x]] [[C|D]] [[Q]]", {"A b": "Z", "C": "D"}) == "[[Z|A_b]] [[Z|x]] [[D]] [[Q]]"
    assert T.redirect_html('<a href="/wiki/A_b">', {"A b": "Z y"}) == '<a href="/wiki/Z_y">'
    got = T.html_paragraphs("<p>one <a href='/wiki/x'>two<p>three</p><a>no")
    assert got == [{"text": "one two", "anchors": [{"href": "/wiki/x", "text": "two"}]}, {"text": "three", "anchors": []}]
    assert T.wikitext_to_html("<!--" + "x" * 200_000 + "-->") == ""


def test_cleaning_and_splitting(spark):
    assert one(spark, T.cleaned(F.lit("I  saw é a b[12] x\ncafé."))) == "I saw a caf."
    assert one(spark, T.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.markup_consistent(F.lit("[[a]] <nowiki>[</nowiki>"), True)) and not one(spark, T.markup_consistent(F.lit("[[a]] <nowiki>[</nowiki>")))
    assert one(spark, T.residual_markup(F.lit("a [[b '''c"))) == ["[", "''"]
    assert one(spark, T.treebank_tokens(F.lit("Don't go, 3.5 times!"))) == ["Don't", "go", ",", "3.5", "times", "!"]


def test_uris(spark):
    u = F.lit("http://dbpedia.org/resource/alain_Connes")
    assert one(spark, U.clean_name(u)) == "alain Connes" and one(spark, U.capitalized(u)).endswith("/Alain_Connes") and one(spark, U.internal_link(u)) == "/wiki/alain_Connes"
    assert one(spark, U.article_url(u)) == "http://en.wikipedia.org/wiki/alain_Connes" and one(spark, U.is_number(F.lit("12"))) and not one(spark, U.is_number(F.lit("1a")))
    assert one(spark, U.abbreviated_type(F.lit("http://www.w3.org/2002/07/owl#Thing"))) == "owlThing"


def test_scores(spark):
    assert math.isclose(one(spark, match.position_score(F.lit(0.9), F.lit(1.0))), 0.81)
    score = match.match_score(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.81), F.lit(0.4), F.lit(0.9), F.lit(0.6))
    assert math.isclose(one(spark, score), 0.8215 / 1.75)
    assert one(spark, match.match_score(F.lit(0.0), F.lit(0.5), F.lit(0.8), F.lit(0.4), F.lit(0.9), F.lit(0.6))) == 0
    assert one(spark, match.syntax_score(F.lit(0), F.lit(0), F.lit(1), F.lit(3), F.lit(1))) == 0


def test_evaluation_and_probability(spark):
    schema = "s string, p string, o string"
    truth = spark.createDataFrame([(str(i), "p", "x") for i in range(4)], schema)
    got = facts_of.evaluation(spark.createDataFrame([("0", "p", "x"), ("1", "p", "x"), ("9", "p", "x")], schema), truth).first()
    assert (got.precision, got.recall) == (2 / 3, 1 / 2) and math.isclose(got.f, 4 / 7)
    assert facts_of.same_facts(truth, truth) and not facts_of.same_facts(truth, truth.limit(1))
    kept = spark.createDataFrame([("P", "subject", "T", 5, 10), ("Q", "subject", "T", 5, 20)], "p string, side string, type string, n long, facts long")
    assert {r.p: round(r.probability, 9) for r in types.type_probability(kept).collect()} == {"P": round(2 / 3, 9), "Q": round(1 / 3, 9)}


def test_files(spark, tmp_path):
    lines = ["<http://x/A> <http://x/p> <http://x/B> .", '<http://x/A> <http://x/p> "5"^^<http://x/int> .', "<a> <b> .", "<http://x/A__1> <p> <q> .", "<a> <b> <c> <d> ."]
    (tmp_path / "f.nt").write_text("\n".join(lines))
    facts = rdf.scan_triples(spark, str(tmp_path / "f.nt"))
    assert [r.o for r in facts.orderBy("line_no").collect()] == ["http://x/B", "http://x/int"]
    rdf.write_triples(facts, str(tmp_path / "out"))
    assert facts_of.same_facts(rdf.scan_triples(spark, str(tmp_path / "out")), facts)
    assert {r.s for r in rdf.cleaned_names(facts).collect()} == {"A"} and rdf.from_random_line(facts, 1).count() <= 2
    assert rdf.clean_assertions(facts, ["http://x/p"], complain=True).count() == 2
    (tmp_path / "r.csv").write_text("A#B\nA#C\n")
    assert [tuple(r) for r in tables.read_redirects(spark, str(tmp_path / "r.csv")).collect()] == [("A", "C")]
    (tmp_path / "i.csv").write_text("A#B_C\n")
    assert tables.read_types_index(spark, str(tmp_path / "i.csv")).count() == 2
    store = tables.Store(spark, str(tmp_path / "store"))
    store.save(training_resource=facts.select("s"))
    assert store.training_resource.count() == 2
    (tmp_path / "blocks").write_text("a\nb\n\nc")
    assert articles.read_blocks(spark, str(tmp_path / "blocks")).count() == 2


def test_articles_to_tagged_sentences(spark, tmp_path):
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>Ann Lee</title><ns>0</ns><id>1</id><revision><text>Ann was born in [[New York|York]]. She left.\n\nx</text></revision></page></mediawiki>")
    pages = articles.read_dump(spark, str(tmp_path / "dump.xml"))
    subjects = spark.createDataFrame([("http://dbpedia.org/resource/Ann_Lee",), ("http://dbpedia.org/resource/Nobody",)], "s string")
    html = articles.articles_of(subjects, pages)
    assert sorted(len(r.html) > 0 for r in html.collect()) == [False, True]
    (got,) = articles.tag_sentences(html).collect()
    assert [(t.text, t.link) for t in got.tokens] == [("Ann", None), ("was", None), ("born", None), ("in", None), ("York", "/wiki/New_York"), (".", None)]
    assert articles.fetched(subjects, lambda u: u).first().html == "http://en.wikipedia.org/wiki/Ann_Lee"


def test_prefix_closure(spark):
    rows = spark.createDataFrame([("r", [], "w", 9), ("r", ["a>"], "w", 3), ("r", ["a>", "b<"], "w", 3), ("r", ["c>", "b<"], "w", 9)], "relation string, path array<string>, word string, n long")
    assert sorted(len(r.path) for r in pattern.closed(rows, ["relation"]).collect()) == [0, 1, 2]
    assert pattern.violations(rows).collect()[0].what == "orphan"
    assert list(pattern.walk(["a", "b", "c"], [0, 1, 2], ["root", "x", "auxpass"], 1, 1, ("auxpass",))) == [([], "a"), (["x>"], "b"), (["x>", "auxpass>"], "c")]


def test_config(tmp_path):
    (tmp_path / "c.ini").write_text("[a]\nrelation_types = spouse, ,x;y,almaMater\nfacts_limit = 7\nuse_dump = False\nmatch_threshold = 0.25\n")
    c = Config.read(tmp_path / "c.ini")
    assert (c.facts_limit, c.use_dump, c.match_threshold, c.depth) == (7, False, 0.25, 2)
    assert [r.rsplit("/", 1)[1] for r in c.relations()] == ["spouse", "almaMater"]
