"""Cases of trees, candidates, hierarchies, redirects and markup that went wrong once, or need a brute-force check."""

import http.server
import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phraseweave.functions import text as T
from phraseweave.operators import match, pattern, types
from phraseweave.sources import articles


def test_a_cyclic_parse_ends():
    found = list(pattern.walk(["a", "b", "c"], [3, 1, 2], ["auxpass"] * 3, 1, 2, ("auxpass",)))
    assert sorted(w for _, w in found) == ["a", "b", "c"]


def test_main_address(spark):
    heads, labels = [0, 1, 1, 3, 3, 3], ["root", "x", "y", "z", "z", "w"]
    df = spark.createDataFrame([(heads, labels, [0, 2]), (heads, labels, [1, 3]), (heads, labels, [4, 0])], "heads array<int>, labels array<string>, at array<int>")
    assert [r[0] for r in df.select(pattern.main_address(F.col("heads"), F.col("labels"), F.col("at"))).collect()] == [1, 2, 1]
    rows = spark.createDataFrame([(7, i, "w", h, x) for i, (h, x) in enumerate(zip(heads, labels, strict=True), 1)], "sentence_id long, idx int, word string, head int, deprel string")
    addresses = spark.createDataFrame([(7, "a", 1), (7, "a", 3), (7, "b", 2), (7, "b", 4)], "sentence_id long, link string, idx int")
    assert {(r.link, r.idx) for r in pattern.head_tokens(rows, addresses).collect()} == {("a", 1), ("b", 2)}


def cut_by_cut(rows, least):
    """The tree cut at 2, 3, ... as long as what reaches the count is enough."""
    total, t = sum(rows.values()), 2
    while True:
        reaching = sum(n for n in rows.values() if n >= t)
        if not reaching or reaching < total * least:
            return rows
        rows = {k: n for k, n in rows.items() if n >= t}
        while True:
            paths = {p for p, _ in rows}
            closed = {(p, w): n for (p, w), n in rows.items() if all(p[:i] in paths for i in range(1, len(p)))}
            if len(closed) == len(rows):
                break
            rows = closed
        t += 1


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5, 0.8, 0.99])
def test_dynamic_cuts_against_brute_force(spark, least):
    rng = random.Random(5)
    trees = defaultdict(dict)
    for r in range(6):
        for _ in range(60):
            path = tuple(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
            for i in range(1, len(path) + 1):
                trees[f"r{r}"].setdefault((path[:i], rng.choice("xyz")), rng.randrange(1, 3 + 3 * r))
    flat = [(r, list(p), w, n) for r, rows in trees.items() for (p, w), n in rows.items()] + [(r, [], "root", 50) for r in trees]
    got = pattern.clean_words(spark.createDataFrame(flat, "relation string, path array<string>, word string, n long"), least).collect()
    want = {(r, p, w, n) for r, rows in trees.items() for (p, w), n in cut_by_cut(rows, least).items()}
    assert {(x.relation, tuple(x.path), x.word, x.n) for x in got} == want and len(got) == len(want)


def test_untyped_entities_get_every_relation(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("b",)], "entity string")
    relations = spark.range(12_000).select(F.concat(F.lit("r"), "id").alias("relation"))
    typed = spark.createDataFrame([("b", "T")], "entity string, type string")
    knows = spark.createDataFrame([("r5", "T")], "relation string, type string")
    got = match.candidate_relations(entities, typed, knows, relations).groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in got} == {"a": 12_000, "b": 1}
    assert match.candidate_relations(entities, typed, knows, relations, allow_unknown=False).collect() == [("b", "r5")]
    assert match.candidate_relations(entities, typed, knows, relations.limit(0)).count() == 1


def test_deep_and_cyclic_hierarchies(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(70)] + [("x", "y"), ("y", "x")]
    got = types.ancestors(spark.createDataFrame(chain, "type string, parent string"))
    assert got.filter("type = 't0'").count() == 71
    assert sorted(tuple(r) for r in got.filter("type = 'x'").collect()) == [("x", "x"), ("x", "y")]


def test_redirects_of_rows_with_nulls_and_repeats(spark):
    rows = [(1, None, "[[A b]]"), (1, None, "[[A b]]"), (None, "t", "[[C]] [[A_b|z]]"), (3, "u", None), (4, "v", "none")]
    table = spark.createDataFrame(rows, "article_key long, found string, wikitext string").repartition(3)
    redirects = spark.createDataFrame([("A b", "Z", 1), ("A_b", "Y", 2), ("C", "D", 1)], "src string, dst string, line_no long")
    got = articles.redirect_links(table, redirects)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "[[Y|A b]]")] * 2 + [(None, "t", "[[D|C]] [[Y|z]]"), (3, "u", None), (4, "v", "none")], key=str)


def test_rows_of_one_subject_keep_their_own_anchors(spark):
    html = ["<p>See <a href='/wiki/A'>red</a> car. No link\nhere. A blue car</p>", "<p>See <a href='/wiki/B'>red</a> car.</p>"]
    got = articles.tag_sentences(spark.createDataFrame([("s", h) for h in html], "s string, html string")).collect()
    assert sorted(tuple(t.link for t in r.tokens) for r in got) == [(None, "/wiki/A", None, None), (None, "/wiki/B", None, None)]
    sought = spark.createDataFrame([("s", html[0], ["/wiki/B"]), ("s", html[1], ["/wiki/B"])], "s string, html string, wanted array<string>")
    assert [[t.link for t in r.tokens] for r in articles.tag_sentences(sought, sought="wanted").collect()] == [[None, "/wiki/B", None, None]]


@pytest.mark.parametrize(
    ("markup", "html"),
    [
        ("{{a{{b}}c}}x<!-- y\n -->", "x"),
        ("keep\n== Further reading ==\ngone", "keep\n"),
        ("keep\n==References==\ngone", "keep\n"),
        ("= Top =\n== a=b == rest", "\n\n\n rest"),
        ('a<ref name="x"/> b<Ref>z</Ref> c<ref\nn="1">\n</ref>', "a b c"),
        ("<references>..</references> b<ref>z</ref>", "<references>..</references> b"),
        ("[[Image:x|[[y]] z]]a [http://u v [w]]b [//not a link]", "a b //not a link"),
        ("[[Category:C d]]a* b", "ab"),
        ("'''b''' ''i''", "b i"),
        ("one\ntwo\n\nthree\n\n\nlast", "<p>one\ntwo</p>\n\n<p>three</p>\nlast"),
        ("[[A b|c]] [[D e]] [[F|]] [x]", '<a href="/wiki/A_b">c</a> <a href="/wiki/D_e">D e</a> <a href="/wiki/F">F</a> x'),
        (None, ""),
    ],
)
def test_steps_of_the_conversion(markup, html):
    assert T.wikitext_to_html(markup) == html


def test_residues(spark):
    got = spark.createDataFrame([("a == {b} <ref>c''",), ("clean",), ("[x] <ref name",)], "h string").select(T.residual_markup(F.col("h")).alias("r")).collect()
    assert [r.r for r in got] == [["==", "{", "}", "<ref>", "''"], [], ["[", "]", "<ref "]]


def test_pages_are_fetched():
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "none" in self.path else 200)
            self.end_headers()
            if "none" not in self.path:
                self.wfile.write("<p>é</p>".encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert articles.fetch_html(f"{at}/wiki/A") == "<p>é</p>" and articles.fetch_html(f"{at}/none") == ""
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        articles.fetch_html("http://127.0.0.1:1/", timeout=1, tries=2)
