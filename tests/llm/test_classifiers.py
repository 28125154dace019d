import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phraseweave.llm.common import fold
from phraseweave.llm.hashed_terms import gains, incidence, labelled_sample, least_texts, words_and_prefixes
from phraseweave.llm.quality import CumulativeLink, drop_low_quality, grade_quality, shape
from phraseweave.llm.toxicity import FactorizationMachine, drop_toxic, score_toxicity

DOCS = "doc_id long, text string, label int, score string, terms int"


def corpus(n=700):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(15, 60))]
        toxic, low = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.choice([1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "Moron", "scum,"])
        if low:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if rng.random() < 0.5 else [rng.choice(words)] * 50
            toxic = toxic and int(any(x in " ".join(words) for x in ("idiot", "Moron", "scum")))
        docs.append((i, " ".join(words), None, "x", 1))
        labels.append((i, 1 - low, toxic))
    docs += [(n, None, 1, "", 1), (n + 1, "", 1, "", 1), (n + 2, "word " * 5000, 1, "", 1), (None, "idiot", 1, "", 1), (3, docs[3][1], 1, "", 1)]
    return docs, [*labels, (None, 1, 1), (n + 50, 1, 1), (n + 51, None, None)]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_of_held_out_texts(spark):
    docs, labels, truth = frames(spark)
    got = score_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0).withColumn("held", fold(F.col("doc_id"), 5) == 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {i: t for i, _, t in truth}
    held = [r for r in got if r.held and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (700, 701, 702))
    left = drop_toxic(docs, labels, fold(F.col("doc_id"), 5) != 0)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_quality_of_held_out_texts(spark):
    docs, labels, truth = frames(spark)
    got = grade_quality(docs, labels, fold(F.col("doc_id"), 5) != 0).withColumn("held", fold(F.col("doc_id"), 5) == 0).collect()
    good = {i: q for i, q, _ in truth}
    held = [r for r in got if r.held and r.doc_id in good]
    assert sum(r.keep == good[r.doc_id] for r in held) >= 0.98 * len(held)
    left = drop_low_quality(docs, labels, fold(F.col("doc_id"), 5) != 0)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in got)


def test_nothing_to_learn_from(spark):
    docs, labels, _ = frames(spark)
    assert score_toxicity(docs.limit(9), labels, F.lit(False)).agg(F.sum("predicted")).first()[0] == 0
    assert grade_quality(docs.limit(9), labels, F.lit(False)).agg(F.sum("keep")).first()[0] == 9
    assert score_toxicity(docs.limit(0), labels, F.lit(True)).collect() == []
    assert grade_quality(docs.limit(0), labels, F.lit(True)).collect() == []


def either(n, filler, seed=0):
    """Texts in which exactly one of two words makes the label; alone each says nothing."""
    rng = random.Random(seed)
    vocab = [f"f{i}" for i in range(500)]
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(vocab, filler) + ["alpha"] * a + ["beta"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a != b)))
    return rows


@pytest.mark.parametrize(("n", "filler"), [(400, 6), (3000, 30)])
def test_pairs_tell_what_single_terms_can_t(spark, n, filler):
    """An exclusive-or of two terms: no sum of weights separates it."""
    rows = either(n, filler)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i] == t for i, _, t in held) >= 0.95 * len(held)


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 40).astype(float)
    pairs = np.unique(rng.integers(0, 400, 250))
    rows, columns = pairs // 10, pairs % 10
    p = {"bias": rng.normal(size=1), "weight": rng.normal(size=10), "factors": rng.normal(size=(10, 3))}

    def loss(p):
        logit = FactorizationMachine(np.arange(10), p["bias"], p["weight"], p["factors"]).logits(rows, columns, 40)[0]
        return np.mean(np.log1p(np.exp(logit)) - y * logit) + 0.5 * 0.01 * (p["factors"] ** 2).sum()

    compare(loss, p, FactorizationMachine(np.arange(10), p["bias"], p["weight"], p["factors"]).slopes(y, rows, columns, 0.01))
    grade = rng.integers(0, 4, 40)
    q = {"low": rng.normal(size=1), "gaps": rng.normal(size=2), "weight": rng.normal(size=10)}

    def unlikeliness(q):
        total = 0.0
        for i in range(40):
            z, theta = q["weight"][columns[rows == i]].sum(), q["low"][0] + np.concatenate([[0], np.cumsum(np.exp(q["gaps"]))])
            up_to = [0.0, *(1 / (1 + np.exp(z - theta))), 1.0]
            total -= np.log(up_to[grade[i] + 1] - up_to[grade[i]])
        return total / 40 + 0.5 * 0.01 * (q["weight"] ** 2).sum()

    assert abs(unlikeliness(q) - 0.5 * 0.01 * (q["weight"] ** 2).sum() + np.log(CumulativeLink.chances(q, grade, rows, columns)[0]).mean()) < 1e-12
    compare(unlikeliness, q, CumulativeLink.slopes(q, grade, 4, rows, columns, 0.01))


def compare(loss, p, slopes, step=1e-6):
    for name, values in p.items():
        for at in np.ndindex(values.shape):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            assert abs((loss(up) - loss(down)) / (2 * step) - slopes[name][at]) < 1e-6, (name, at)


def test_gains_and_the_terms_that_can_reach_them():
    y = np.array([1.0] * 30 + [0.0] * 70)
    rows, columns = np.array([*range(10), *range(20, 50), 99]), np.array([0] * 10 + [1] * 30 + [2])
    got = gains(y, np.full(100, 0.3), rows, columns, 3)
    assert np.allclose(got, [20 * np.log(1 / 0.3), 2 * (10 * np.log(10 / 9) + 20 * np.log(20 / 21)), 2 * np.log(1 / 0.7)])
    assert got[0] < 36 and least_texts(0.3, 36.0) == pytest.approx(36 / (2 * np.log(1 / 0.3)))
    terms, rows, columns = incidence([np.array([3, 5], np.int32), np.array([5, 9], np.int32), np.array([], np.int32)], 2)
    assert (list(terms), list(rows), list(columns)) == ([5], [0, 1], [0, 0])


def test_the_sample_is_bounded_in_rows_and_terms(spark):
    docs = spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(10))) for i in range(50)] + [(3, None), (4, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sizes = [[len(t) for t in labelled_sample(docs, labels, "toxic", F.lit(True), most, held, words_and_prefixes)[1]] for most, held in ((1000, 10**6), (20, 10**6), (1000, 100))]
    assert len(sizes[0]) == 52 and len(sizes[1]) == 20 and 0 < sum(sizes[2]) <= 100


def test_pair_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = FactorizationMachine(np.arange(6), np.array([0.3]), rng.normal(size=6), rng.normal(size=(6, 3)))
    rows, columns = np.array([0, 0, 0, 2, 2]), np.array([1, 3, 5, 0, 4])
    got, _ = model.logits(rows, columns, 3)
    for i in range(3):
        own = columns[rows == i]
        want = 0.3 + model.weight[own].sum() + sum(model.factors[a] @ model.factors[b] for k, a in enumerate(own) for b in own[k + 1 :])
        assert abs(got[i] - want) < 1e-12


def test_more_than_two_grades():
    rng = np.random.default_rng(1)
    y, texts = [], []
    for _ in range(900):
        z = rng.integers(0, 3)
        y.append(int(z) * 2 + 1)
        texts.append(np.sort(np.append(rng.choice(np.arange(50, 90), 5, replace=False), [z + 10] if rng.random() < 0.95 else [])).astype(np.int32))
    model = CumulativeLink.fit(np.array(y), texts)
    assert list(model.grades) == [1, 3, 5] and (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([0, 1, 2]), np.searchsorted(model.terms, [10, 11, 12]), 3)
    expected = 1 + tails @ np.diff(model.grades)
    assert expected[0] < 2 < expected[1] < 4 < expected[2] and (tails[:, 0] >= tails[:, 1]).all()


def test_terms_and_shapes():
    assert [shape(t) for t in ("The", "THE!!", "the&&&", "|", "x1.5", "ÜBER", "")] == ["a", "L!!", "a&&", "|", "a0.0", "L", ""]
    rows, terms = words_and_prefixes(pa.array(["Under under undercut", None, "ab"]))
    assert [int((rows == i).sum()) for i in range(3)] == [4, 0, 3]  # under, undercut and the beginnings unde and under
