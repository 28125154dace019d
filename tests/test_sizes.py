"""Work that must not grow faster than its input: where trees are counted and looked up, what is shuffled, how rows are dealt."""

import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phraseweave import session
from phraseweave.functions import text as T
from phraseweave.operators import facts as facts_of
from phraseweave.operators import pattern, trees, types
from phraseweave.plans import queries as plans
from phraseweave.sources import rdf

OBJECTS = "pattern_id long, relation string, words array<string>, heads array<int>, labels array<string>, start int"


def parsed(count, seed=3):
    """Rows with random parses, cycles and second roots among them."""
    rng, rows = random.Random(seed), []
    for i in range(count):
        n = rng.randrange(1, 12)
        rows.append((i, f"r{i % 3}", [rng.choice("abc") for _ in range(n)], [rng.randrange(n + 1) for _ in range(n)], [rng.choice(["x", "y", "auxpass", "root"]) for _ in range(n)], rng.randrange(1, n + 1)))
    return rows


def plain_trees(rows):
    return {i: Counter((tuple(p), w) for p, w in pattern.walk(words, heads, labels, start, 2, pattern.FREE_LABELS)) for i, _, words, heads, labels, start in rows}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_of_a_batch_against_single_walks(spark):
    rows = parsed(300)
    columns = dict(zip(("pattern_id", "relation", "words", "heads", "labels", "start"), zip(*rows, strict=True), strict=True))
    batch = pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()})
    for part, first in ((batch, 0), (batch.slice(40, 100), 40)):
        tree = trees.Trees(part, 2, pattern.FREE_LABELS)
        got = {(first + r, (tuple(tree.paths[p]), tree.words[w].as_py())): n for r, p, w, n in zip(*(x.tolist() for x in tree.counts()), strict=True)}
        assert got == {(i, k): n for i, tree in plain_trees(rows[first : first + part.num_rows]).items() for k, n in tree.items()}
    with pytest.raises(ValueError):
        trees.Trees(pa.RecordBatch.from_pydict({"words": [["a"]], "heads": [[2]], "labels": [["x"]], "start": [1]}), 2, ())


def test_trees_are_merged_without_their_rows(spark):
    rows = parsed(200)
    objects = spark.createDataFrame(rows, OBJECTS)
    want = Counter()
    for i, tree in plain_trees(rows).items():
        for (path, word), n in tree.items():
            want[f"r{i % 3}", path, word] += n
    merged = pattern.merged(objects)
    assert {(r.relation, tuple(r.path), r.word): r.n for r in merged.collect()} == want
    assert "hashpartitioning(pattern_id" not in plan_of(merged) and "Exchange" not in plan_of(pattern.sentence_patterns(objects))


@pytest.mark.parametrize("most", [None, 60, 1])
def test_what_trees_have_in_common_with_learnt_ones(spark, most):
    rows = parsed(150)
    objects = spark.createDataFrame(rows, OBJECTS)
    learnt = pattern.clean_words(pattern.merged(objects), 2).cache()
    assert 60 < learnt.count() and {None: 1, 60: 2}.get(most, 0) <= len(pattern.lookups(learnt, most) or [])
    by_relation = defaultdict(dict)
    for r in learnt.collect():
        by_relation[r.relation][tuple(r.path), r.word] = r.n
    want = {}
    for i, tree in plain_trees(rows).items():
        for relation, known in by_relation.items():
            both = {k: min(n, known[k]) for k, n in tree.items() if k in known}
            paths = {p for p, _ in both}
            want |= {(i, relation, p, w): n for (p, w), n in both.items() if all(p[:k] in paths for k in range(1, len(p)))}
    found = pattern.common_rows(objects, learnt, ("pattern_id",), most=most)
    assert {(r.pattern_id, r.relation, tuple(r.path), r.word): r.n for r in found.collect()} == want
    sums = Counter()
    for (i, relation, _, _), n in want.items():
        sums[i, relation] += n
    got = pattern.common_sums(objects, learnt, ("pattern_id",), most=most).collect()
    assert {(r.pattern_id, c.relation): c.n for r in got for c in r.common} == sums
    assert {r.pattern_id: r.own for r in got} == {i: sum(t.values()) for i, t in plain_trees(rows).items()}
    assert most == 1 or most == 60 or "Exchange" not in plan_of(found)


def test_paragraphs_of_long_text_without_blank_lines():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab\n\n\r") for _ in range(rng.randrange(14)))
        assert T.mark_paragraphs(text) == re.sub(r"(?s)([^\n].+?)\n\n", r"<p>\1</p>", text)
    begun = time.process_time()
    assert T.wikitext_to_html("word " * 40_000) == "word " * 40_000  # a scan from every letter to the end took minutes
    assert time.process_time() - begun < 5


def test_pages_are_parsed_in_bounded_runs():
    pages = ["<p>x</p>" + "y" * 400, None, "", "<p>a<a href='/b'>c</a>", "z" * 3000, "<p>last"]
    runs = list(T.parsed_pages(pa.array(pages), 1000))
    assert len(runs) > 1 and [p for run in runs for p in run.to_pylist()] == [T.html_paragraphs(p) for p in pages]


def test_costly_work_is_dealt_over_all_cores(spark):
    made = plans.QUERIES["html_paragraphs_made"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_heads_are_found_without_a_shuffle(spark):
    assert "Exchange" not in plan_of(plans.QUERIES["head_tokens"](spark, "/root/testdata/sf0.001"))


def test_independence_reads_facts_once(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda s: (read.add(1), s)[1], "string").asNondeterministic()
    facts = spark.createDataFrame([(i, f"x/S{i % 3}", "p" if i % 2 else "q", f"x/O{i % 4}") for i in range(24)], "line_no long, s string, p string, o string").withColumn("s", seen("s"))
    kinds = spark.createDataFrame([("S0", "A"), ("S0", "B"), ("S1", "A"), ("O0", "X"), ("O1", "X"), ("O1", "Y")], "entity string, type string")
    for marked in (False, True):
        before = read.value
        got = {r.p: (r.facts, r.score) for r in types.independence(facts, kinds, mark_untyped=marked).collect()}
        assert read.value - before == 24 and {p: n for p, (n, _) in got.items()} == {"p": 12, "q": 12}
        assert got["q"][1] == pytest.approx(0.0) and got["p"][1] == pytest.approx(0.0)


def test_facts_of_two_tables_are_grouped_once(spark, tmp_path, monkeypatch):
    a = [("s1", "p", "o"), ("s1", "p", "o"), ("s2", "p", None), ("s3", None, "o"), ("s4", "p", "o"), (None, None, None)]
    b = [("s4", "p", "o"), ("s4", "p", "o"), ("s2", "p", None), ("s5", "p", "o")]
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, "s string, p string, o string").write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    new = facts_of.new_facts(left, right)
    assert "Join" not in plan_of(new) and plan_of(new).count("Exchange hash") == 1
    assert Counter(tuple(r) for r in new.collect()) == Counter(set(a) - set(b))
    assert not facts_of.same_facts(left, right) and facts_of.same_facts(left, left.union(left)) and not facts_of.same_facts(left, left.filter("s = 's1'"))
    few = session.parts_of(left, right)
    monkeypatch.setattr(session, "PART_BYTES", 64)
    many = session.parts_of(left, right)
    assert few == spark.sparkContext.defaultParallelism < many < session.parts_of(left, right, right)
    assert facts_of.new_facts(left, right).rdd.getNumPartitions() == many


def test_first_facts_are_found_without_sorting_the_others(spark, monkeypatch):
    rng = random.Random(5)
    lines = rng.sample(range(10_000), 900)
    rows = [(n, f"s{rng.randrange(40)}", rng.choice(["p", "q", "r", None]), f"o{n}") for n in lines]
    batches = [pa.RecordBatch.from_pydict({"line_no": [r[0] for r in part], "s": [r[1] for r in part], "p": [r[2] for r in part]}) for part in (rows[i : i + 37] for i in range(0, 900, 37))]
    by_p = {p: sorted(r[0] for r in rows if r[2] == p) for p in ("p", "q", "r", None)}
    for gathered, kept in ((50_000, 500_000), (50, 500_000), (1, 10)):
        monkeypatch.setattr(rdf, "GATHERED", gathered)
        monkeypatch.setattr(rdf, "KEPT", kept)
        found = pa.Table.from_batches(rdf.firsts_of(iter(batches), 20)).to_pylist()
        assert all({n for n in by_p[p][:20]} <= {r["line_no"] for r in found if r["p"] == p} for p in by_p)
        assert kept == 10 or len(found) == 80
    facts = spark.createDataFrame(rows, "line_no long, s string, p string, o string")
    tests = spark.createDataFrame([("s1",), ("s1",), ("s7",), (None,)], "s string")
    fresh = {p: sorted(r[0] for r in rows if r[2] == p and r[1] not in ("s1", "s7")) for p in by_p}
    first = sorted((fresh[p][0], p) for p in "pqr")[:2]
    got = rdf.training_facts(facts, tests, ["p", "q", "r"], 2, 30)
    assert {(r.p, r.line_no) for r in got.collect()} == {(p, n) for _, p in first for n in fresh[p][:30]} and got.count() == 60
    whole = rdf.first_of_each(facts, 30)
    assert "Sort" not in plan_of(whole).split("MapInArrow")[1]
    # facts are read once
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda s: (seen.add(1), s)[1], "string").asNondeterministic()
    rdf.training_facts(facts.withColumn("s", counted("s")), tests, [], 2, 30).collect()
    assert seen.value == 900
