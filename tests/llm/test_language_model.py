import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phraseweave.llm import language_model
from phraseweave.llm.common import fold
from phraseweave.llm.language_model import score_language_model

SCHEMA = "doc_id long, text string, train string"


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows, order, mu):
    """Counts as dictionaries; the history of a text's beginning is one end mark."""
    grams = [Counter() for _ in range(order + 1)]
    histories = [Counter() for _ in range(order + 1)]
    train = [tokens(t) for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    for t in train:
        padded = [None, *t]
        for i in range(1, len(padded)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    grams[n][tuple(padded[i - n + 1 : i + 1])] += 1
                    histories[n][tuple(padded[i - n + 1 : i])] += 1
    total, distinct = sum(map(len, train)), len(grams[1])
    out, failures = [], 0
    for i, text, *_ in rows:
        padded, base, score, known = [None, *tokens(text)], 0.0, 0.0, 0
        for k in range(1, len(padded)):
            c = grams[1][(padded[k],)]
            known += c > 0
            p = (c + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                left = histories[n][tuple(padded[k - n + 1 : k])] if k - n + 1 >= 0 else 0
                if left:
                    failures += not grams[n][tuple(padded[k - n + 1 : k + 1])]
                    p = (grams[n][tuple(padded[k - n + 1 : k + 1])] + mu * p) / (left + mu)
            score += math.log10(p)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(padded) - 1, known, total, base, score))
    return out, failures


def corpus():
    rng = random.Random(2)
    vocab = [f"W{rng.randrange(60)}ü" for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30))), "x") for i in range(150)]
    return [*rows, (500, None, None), (501, "  \t ", "x"), (3, "again\x0bagain w1", "x"), (None, "W1ü w2ü", "x")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = score_language_model(docs, fold(F.col("doc_id"), 7) != 2, order=order, mus=(5.0,), chunk_bytes=400).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, order, 5.0)[0], key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:7] == pytest.approx(b[5:7], abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_one_reading_follows_arcs_and_failure_arcs(monkeypatch, order):
    rows = corpus()
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "train": [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for r in rows]})
    row = next(language_model._chunk(1 << 20)(iter([batch]))).to_pylist()[0]
    grams, train, place, codes = language_model._grams(row, order)
    counts = [np.bincount(np.unique(g, return_inverse=True)[1], weights=train).astype(np.int64) for g in grams]
    lengths = np.array(row["lengths"])
    # a shorter n-gram stands where there is none of an order: it is never looked up there
    known = language_model.Slice(grams, counts, place, codes, sum(row["train"]))
    want, failures = brute(rows, order, 5.0)
    tokens, words = int(train.sum()), int((counts[0] > 0).sum())
    for stretch in (256, 7, 3):
        monkeypatch.setattr(language_model, "STRETCH", stretch)
        automaton = language_model.BackoffAutomaton(known, tokens, words, (5.0, 50.0))
        got = automaton.read(codes, lengths)
        assert got[:, 0] == pytest.approx([w[6] for w in want], abs=1e-9)
        assert automaton.failures == failures
        assert got[:, 1] == pytest.approx([w[6] for w in brute(rows, order, 50.0)[0]], abs=1e-9)


def test_held_out_texts_gain_from_histories(spark):
    rng = random.Random(3)
    follow = {f"a{i}": [f"a{(3 * i + k) % 40}" for k in range(3)] for i in range(40)}
    rows = []
    for i in range(300):
        word, text = f"a{rng.randrange(40)}", []
        for _ in range(25):
            text.append(word)
            word = rng.choice(follow[word])
        rows.append((i, " ".join(text), ""))
    got = score_language_model(spark.createDataFrame(rows, SCHEMA), fold(F.col("doc_id"), 7) != 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]


def test_empty_table_and_no_training(spark):
    assert score_language_model(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    got = score_language_model(spark.createDataFrame([(1, "a b", "")], SCHEMA), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(3, 0, 0.0, 0.0)]
