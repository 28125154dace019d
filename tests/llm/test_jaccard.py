import itertools
import random
import re

import numpy as np
from pyspark.sql import types as T

from phraseweave.llm.common import Workspace
from phraseweave.llm.jaccard import DEEPEST, candidate_edges, common_levels, jaccard_join, keep_one, matched_depth, shortened, signature

SCHEMA = "doc_id long, text string, key string, class_id int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    return sorted((rows[i][0], min(groups[root(i)]), links[i]) for i in range(len(rows)))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 30, 80, 300]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((n, " ".join(text).title(), "x", 1))
            n += 1
    return [*rows, (n, "", "x", 1), (n + 1, None, "x", 1), (n + 2, "!!! ...", "x", 1), (n + 3, "one", None, None), (n + 4, "ONE?", "x", 1), (0, rows[0][1], "x", 1)]


def test_against_brute_force(spark):
    rows = corpus()
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    got = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "key", "class_id"]
    groups = {}
    for (i, c, _), r in zip(sorted(brute(rows)), sorted(rows, key=lambda r: r[0]), strict=True):
        groups.setdefault(c if words(r[1]) else ("none", i), set()).add(i)
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(g) for g in groups.values())


def test_rows_that_share_an_id_but_no_text_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, "x", 1), (1, b, "x", 1), (2, c, "x", 1), (3, a, "x", 1), (1, a, "w", 2), (None, b, "x", 1), (None, c + " more", "x", 1)]
    rows += [(None, f"{x} alone in its group {x} {x} {x}", "x", n) for x in "pqr" for n in range(3)] + [(None, None, "x", 1)] * 2 + [(7, "", "x", 1)] * 2
    got = keep_one(spark.createDataFrame(rows, SCHEMA).repartition(5))
    kept = sorted(((r.doc_id, r.text, r.key, r.class_id) for r in got.collect()), key=str)
    assert kept == sorted([(1, a, "w", 2), (1, b, "x", 1), (2, c, "x", 1), *((None, f"{x} alone in its group {x} {x} {x}", "x", 0) for x in "pqr"), *[(None, None, "x", 1)] * 2, *[(7, "", "x", 1)] * 2], key=str)


def test_null_ids_meet_only_their_own_texts(spark):
    rows = [(None, f"text number {i // 2} of many rows without any id {i // 2}", "", 0) for i in range(600)]
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 600 and {(r.doc_id, r.class_id, r.copy_id) for r in got} == {(None, None, None)}
    assert sorted(r.n_links for r in got) == sorted(n for _, _, n in brute([(0, *r[1:]) for r in rows]))


def test_blocks_of_a_large_group(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:-1], f"tail{i}"]), "", 0) for i in range(1500)]
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 1499)}


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(empty).collect() == []
    got = jaccard_join(spark.createDataFrame([(None, "a b c d e f", "", 0), (4, "a b c d e f", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.class_id, r.n_links) for r in got) == [(False, 4, 1), (True, 4, 1)]
    assert [f.dataType for f in jaccard_join(empty).schema] == [T.LongType()] * 4


def test_one_depth_for_all_trees():
    assert matched_depth(0.8, 32, 12, 0.9999) == 6
    assert matched_depth(0.8, 32, 12, 0.0) == 12
    assert matched_depth(0.1, 1, 12, 1.0) == 1


def recall_of(depths, threshold):
    return 1 - np.prod([1 - threshold**d for d in depths])


def test_prefixes_are_shortened_where_that_is_cheap():
    matches = np.array([[100 * (DEEPEST - d) for d in range(DEEPEST + 1)]] * 32)
    even = shortened(matches, 0.8, 4, 0.9999)
    assert recall_of(even, 0.8) >= 0.9999 and recall_of([*even[:-1], DEEPEST + 1], 0.8) < 0.99999
    matches[:8, :7] += 10**9  # trees that are dense at six levels keep longer prefixes
    uneven = shortened(matches, 0.8, 4, 0.9999)
    assert min(uneven[:8]) >= 7 and min(uneven[8:]) < 7 and recall_of(uneven, 0.8) >= 0.9999
    assert shortened(matches, 0.8, 4, 0.0) == [DEEPEST] * 32


def test_levels_that_paths_share():
    a = np.array([[1 << 60, 5], [7, 5], [7, 5], [0, 0]], np.uint64)
    b = np.array([[1 << 61, 5], [7, 6], [7, 5], [1 << 20, 0]], np.uint64)
    assert list(common_levels(a, b)) == [0, 7, 8, 2]


def test_measured_recall_of_the_forest(spark):
    """Pairs at a Jaccard index of 0.8 meet as often as asked, over many tasks of the sort, and pairs of less hardly."""
    rng = np.random.default_rng(2)
    rows, pairs = [], 400
    for i in range(2 * pairs):
        shared = 160 if i < pairs else 60
        every = rng.integers(0, 2**64, 2 * 180 - shared, dtype=np.uint64)
        for j, own in enumerate((every[:180], every[180 - shared :])):
            rows.append((2 * i + j, bytearray(signature(np.sort(own), 32, 7).tobytes())))
    nodes = spark.createDataFrame(rows, "key long, paths binary").repartition(11)
    for target in (0.9999, 0.99, 0.9):
        edges = candidate_edges(nodes, 32, 0.8, target, Workspace(spark, "test")).distinct().collect()
        met = {e.src // 2 for e in edges if e.src // 2 == e.dst // 2}
        near = sum(m < pairs for m in met) / pairs
        assert near >= target - 0.06 and sum(m >= pairs for m in met) < 0.1 * pairs
