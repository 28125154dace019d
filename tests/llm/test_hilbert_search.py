import math

import numpy as np
import pytest

from phraseweave.llm.hilbert_search import best_pairs, hilbert_keys, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, point int, vector string"


@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_a_curve_steps_to_a_neighbouring_cell(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    (keys,) = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_words_of_a_long_key_sort_like_the_curve():
    cells = np.random.default_rng(1).integers(0, 1 << 10, (300, 8))
    fine, coarse = hilbert_keys(cells, 10), hilbert_keys(cells >> 3, 7)
    assert len(fine) == 2 and len(coarse) == 1
    assert (fine[0] == coarse[0]).all()


def test_exact_choice_among_ties():
    others = np.eye(6)
    scores = np.zeros((1, 6), np.float32)
    row, column, exact = best_pairs(scores, np.array([[0, 0, 0, 0, 0, 1.0]]), others, np.array([9, 3, 8, 1, 7, 2]), 3)
    assert list(column) == [5, 3, 1] and list(exact) == [1.0, 0.0, 0.0]


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((-float(v @ w / math.sqrt((v @ v) * (w @ w))), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def corpus(n):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    return [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.7 * rng.normal(size=16)]) for i in range(n)]


def test_recall_and_scores(spark):
    rows = corpus(3000)
    got = nearest_neighbours(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), fit_rows=500).collect()
    truth = brute(rows)
    mine = {}
    for r in sorted(got, key=lambda r: r.rank):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert mine.keys() == truth.keys() and all(len(v) == 5 for v in mine.values())
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 5 * len(truth)
    vectors = dict(rows)
    for q, found in mine.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        a = np.array(vectors[q])
        for i, score in found:
            b = np.array(vectors[i])
            assert score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_copies_and_rows_that_take_no_part(spark):
    hot = [1.0] + [0.0] * 15
    rows = [(i, hot) for i in range(400)] + [(1000 + i, v) for i, v in corpus(30)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [math.nan] * 16), (2150, [1.0, None] + [0.0] * 14), (2200, [math.inf] + [0.0] * 15), (2250, [1.0]), (2300, []), (0, hot)]
    docs = spark.createDataFrame([*[(*r, 0, "") for r in rows], (None, hot, 0, "")], SCHEMA).repartition(5)
    mine = {}
    for r in sorted(nearest_neighbours(docs).collect(), key=lambda r: r.rank):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    assert mine.keys() == {*range(0, 400, 50), 1000}
    assert mine[0] == [1, 2, 3, 4, 5] and mine[50] == [0, 1, 2, 3, 4]


def test_parallel_vectors_and_equal_cosines_go_by_id(spark):
    rng = np.random.default_rng(8)
    line = [float(x) for x in rng.integers(-9, 9, 16).astype(np.float32)]
    rows = [(i, [x * 2.0 ** (i * 7 % 61 - 30) for x in line]) for i in range(61)]
    # cosine 0 with each of many directions
    rows += [(1000 + i, [float(j == i % 16) * (-1 if i // 16 % 2 else 1) for j in range(16)]) for i in range(200)]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(7)
    mine = {}
    for r in sorted(nearest_neighbours(docs).collect(), key=lambda r: r.rank):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    assert mine[0] == [1, 2, 3, 4, 5] and mine[50] == [0, 1, 2, 3, 4]
    assert mine[1000] == [1032, 1064, 1096, 1128, 1160]


def test_recall_on_queries_that_the_windows_were_not_fit_on(spark):
    rng = np.random.default_rng(12)
    every = rng.normal(size=(6000, 24)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(every)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, sample=60, fit_rows=500).collect()
    units = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    near = units[::10] @ units.T
    near[np.arange(600), np.arange(0, 6000, 10)] = -2
    truth = np.argsort(-near, axis=1)[:, :5]
    hits = sum(r.vec_id in truth[r.query_id // 10] for r in got)
    assert len(got) == 3000 and hits >= 0.9 * 3000


def test_every_query_gets_as_many_as_there_are(spark):
    """Pairs of vectors far from all others: narrow windows would hold the own partner alone."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(0, 400, 2):
        centre = rng.normal(size=12)
        rows += [(i + j, [float(np.float32(x)) for x in centre + 1e-4 * rng.normal(size=12)]) for j in (0, 1)]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    for k in (1, 5, 30):
        got = nearest_neighbours(docs, every=4, k=k, sample=20).groupBy("query_id").count().collect()
        assert len(got) == 100 and {r["count"] for r in got} == {k}


def test_few_rows(spark):
    docs = spark.createDataFrame([(50, [1.0, 0.0], 0, ""), (7, [0.0, 2.0], 0, ""), (8, [1.0, 1.0], 0, "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(docs).orderBy("rank").collect()] == [(50, 1, 8, 0.707107), (50, 2, 7, 0.0)]
    assert nearest_neighbours(docs.filter("vec_id = 50")).collect() == []
    assert nearest_neighbours(docs.filter("vec_id = 8")).collect() == []
    assert nearest_neighbours(docs.limit(0)).collect() == []
