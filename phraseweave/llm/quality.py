"""Quality grades by ordinal cumulative-link regression over hashed terms.

P(grade <= k) = logistic(theta_k - w x): one weight for each hashed term, shared by all grades,
and ordered thresholds theta. Terms of a text: its words, the shapes of its tokens (which kinds of
characters follow each other) by how common they are in the text, and how often tokens repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import WORD_BYTES, encode, hash_words, release, slices, split_words
from phraseweave.llm.hashed_terms import Adam, distinct_pairs, gains, incidence, keep_rows, labelled_sample, least_texts, place, select
from phraseweave.llm.toxicity import LEAST_GAIN, logistic

AS_IS = bytes(range(256))
LOWER, UPPER, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"\d+")
#: Runs of one sign count as two of it.
SIGNS = re.compile(r"(\W)\1+")


def shape(token: str) -> str:
    """Kinds of characters in a token, in order: L capitals alone, a other letters, 0 digits, signs as they are."""
    kinds = DIGITS.sub("0", LOWER.sub(lambda m: "L" if UPPER.fullmatch(m[0]) else "a", token))
    return SIGNS.sub(r"\1\1", kinds)[:12]


def level(share: np.ndarray) -> np.ndarray:
    """Shares of a text on a scale of halves: 0 for all, 1 from a half, ... 6 for less than a 32nd."""
    return np.minimum(6, np.ceil(-np.log2(np.maximum(share, 1e-9)) - 1e-9)).astype(np.int64)


def words_and_shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and as terms of their own each shape, repeated neighbours and distinct tokens with their share of the tokens."""
    at, flat = split_words(texts, WORD_BYTES)
    codes, words = encode(flat)
    rows, terms = [np.repeat(np.arange(len(texts)), np.diff(at))], [place(hash_words(words))[codes]]
    at, flat = split_words(texts, AS_IS)
    codes, tokens = encode(flat)
    count = np.diff(at)
    row = np.repeat(np.arange(len(texts)), count)
    salt = lambda kind, levels: place(hash_words(pa.array([f"{kind} {int(x)}" for x in range(levels)])))
    of, shapes = encode(pa.array([shape(t) for t in tokens.to_pylist()], pa.string()))
    pair, n = np.unique(row * max(1, len(shapes)) + (of[codes] if len(codes) else codes), return_counts=True)
    r, s = (pair // max(1, len(shapes))).astype(np.int64), (pair % max(1, len(shapes))).astype(np.int64)
    table = np.stack([place(hash_words(pa.array([f"{x} {k}" for x in shapes.to_pylist()], pa.string()))) for k in range(7)]) if len(shapes) else np.zeros((7, 1), np.int64)
    rows.append(r)
    terms.append(table[level(n / count[r]), s])
    full = np.flatnonzero(count)
    same = np.bincount(row[1:], weights=(codes[1:] == codes[:-1]) & (row[1:] == row[:-1]), minlength=len(texts))
    distinct = np.bincount(np.unique(row * max(1, len(tokens)) + codes) // max(1, len(tokens)), minlength=len(texts))
    rows += [full, full, full]
    terms += [salt("repeated", 7)[level(same[full] / count[full])], salt("distinct", 7)[level(distinct[full] / count[full])], salt("length", 16)[np.minimum(15, np.log2(np.maximum(1, count[full]))).astype(np.int64)]]
    return distinct_pairs(np.concatenate(rows), np.concatenate(terms))


@dataclass
class CumulativeLink:
    terms: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray
    weight: np.ndarray

    @staticmethod
    def _thresholds(low: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        return low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])

    @classmethod
    def fit(cls, y: np.ndarray, texts: list[np.ndarray], steps: int = 400, rounds: int = 4, penalty: float = 1e-5) -> CumulativeLink:
        """Maximum likelihood with a small penalty; the thresholds' gaps are exponentials, so they stay in order.

        A term enters when at some threshold its texts' grades differ by LEAST_GAIN from what the model
        expects of them; then all are trained again, in ``rounds`` rounds at most.
        """
        y = np.asarray(y, np.int64)
        grades = np.unique(y)
        if len(grades) < 2:
            return cls(np.zeros(0, np.int64), np.append(grades, grades[-1:] if len(grades) else [0, 0])[:2], np.array([-30.0]), np.zeros(0))
        n, k = len(y), len(grades)
        grade = np.searchsorted(grades, y)
        beyond = [(y >= g).astype(float) for g in grades[1:]]
        terms, rows, columns = incidence(texts, min(least_texts(b.mean(), LEAST_GAIN) for b in beyond))
        del texts
        m = len(terms)
        share = np.clip(np.array([(grade <= i).mean() for i in range(k - 1)]), 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        p = {"low": start[:1].copy(), "gaps": np.log(np.maximum(np.diff(start), 0.05))}
        weight, active = np.zeros(m), np.zeros(m, bool)
        model = cls(terms[active], grades, start, weight[active])
        r = c = np.zeros(0, np.int64)
        for _ in range(rounds):
            tails = model.tails(r, c, n)
            new = np.any([gains(b, tails[:, i], rows, columns, m) >= LEAST_GAIN for i, b in enumerate(beyond)], axis=0) & ~active
            if not new.any():
                break
            active |= new
            own = np.cumsum(active) - 1
            inside = active[columns]
            r, c = rows[inside], own[columns[inside]]
            p["weight"] = weight[active]
            adam = Adam(0.05)
            for _ in range(steps):
                adam.step(p, cls.slopes(p, grade, k, r, c, penalty))
            weight[active] = p["weight"]
            model = cls(terms[active], grades, cls._thresholds(p["low"], p["gaps"]), p["weight"])
        return model

    @classmethod
    def chances(cls, p: dict[str, np.ndarray], grade: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(grade) of each text's own grade, and the two cumulative probabilities that it is the difference of."""
        z = np.bincount(rows, weights=p["weight"][columns], minlength=len(grade))
        edge = np.concatenate([[-np.inf], cls._thresholds(p["low"], p["gaps"]), [np.inf]])
        above, below = logistic(edge[grade + 1] - z), logistic(edge[grade] - z)
        return np.maximum(above - below, 1e-12), above, below

    @classmethod
    def slopes(cls, p: dict[str, np.ndarray], grade: np.ndarray, grades: int, rows: np.ndarray, columns: np.ndarray, penalty: float) -> dict[str, np.ndarray]:
        """Slopes of the mean negative log-likelihood plus half the penalty times the squared weights."""
        chance, above, below = cls.chances(p, grade, rows, columns)
        d_above, d_below = above * (1 - above) / chance / len(grade), below * (1 - below) / chance / len(grade)
        d_theta = np.array([d_below[grade == i + 1].sum() - d_above[grade == i].sum() for i in range(grades - 1)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        return {"low": tail[:1], "gaps": tail[1:] * np.exp(p["gaps"]), "weight": np.bincount(columns, weights=(d_above - d_below)[rows], minlength=len(p["weight"])) + penalty * p["weight"]}

    def tails(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each text and each grade k but the last."""
        z = np.bincount(rows, weights=self.weight[columns], minlength=n) if len(self.weight) else np.zeros(n)
        return 1 - logistic(self.thresholds[None, :] - z[:, None])


def _tails(model: CumulativeLink):
    return lambda texts: model.tails(*select(*words_and_shapes(texts), model.terms), len(texts))


def _grade(model: CumulativeLink):
    tails = _tails(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tail = tails(part.column("text"))
            expected = model.grades[0] + tail @ np.diff(model.grades).astype(float)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tail[:, -1])], ["doc_id", "expected_grade", "tail_probability"])

    return run


def learn_quality(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 10_000, most_held: int = 8_000_000) -> CumulativeLink:
    # the sample is held by what trains on it alone, and goes with it
    model = CumulativeLink.fit(*labelled_sample(docs, labels, "quality", train, sample, most_held, words_and_shapes))
    release()
    return model


def grade_quality(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 10_000, most_held: int = 8_000_000) -> DataFrame:
    """Expected quality grade of every whole text of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Grades are the distinct values of quality. Only labels for which ``train`` (a condition on
    doc_id) holds are learnt from: those of at most ``sample`` texts with ``most_held`` terms in
    all, chosen by a hash of doc_id. Returns a row for each row: doc_id, expected_grade, tail_probability (of the
    highest grade), keep (1 if that is 0.5 or more).

    Null and empty texts have no terms: their grade is that of the thresholds alone. With fewer
    than two grades to learn from everything is kept. Repeated rows grade alike, null ids stay
    null, an empty table gives no rows.
    """
    model = learn_quality(docs, labels, train, sample, most_held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_grade(model), "doc_id long, expected_grade double, tail_probability double").withColumn("keep", (F.col("tail_probability") >= 0.5).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, train: Column, **parameters) -> DataFrame:
    """The rows of ``docs`` of whose text the highest grade is likelier than not (a chance of 0.5 is enough), with all their columns.

    Null and empty texts go by the thresholds alone; repeated rows and null ids stay or go by their
    text; an empty table stays empty.
    """
    tails = _tails(learn_quality(docs, labels, train, **parameters))
    return keep_rows(docs, lambda texts: tails(texts)[:, -1] >= 0.5)
