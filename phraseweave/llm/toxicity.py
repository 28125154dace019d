"""Toxicity scores by a factorization machine over hashed terms.

log-odds = w0 + sum of w_i + sum over pairs of <v_i, v_j>, over the terms a text has: pairs of
terms, such as an insult with the mention of a group, weigh apart from their sum. The pair sum
is (|sum v|^2 - sum |v|^2) / 2, so a text costs as much as its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import release, slices
from phraseweave.llm.hashed_terms import Adam, gains, incidence, keep_rows, labelled_sample, least_texts, pair_directions, select, words_and_prefixes

#: Log-likelihood ratio from which a term enters the machine, and standard deviations of a pair's slope from which its terms do.
LEAST_GAIN, LEAST_SLOPE = 36.0, 6.0


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class FactorizationMachine:
    terms: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, y: np.ndarray, texts: list[np.ndarray], factors: int = 4, steps: int = 300, rounds: int = 4, penalty: float = 1e-5, seed: int = 0) -> FactorizationMachine:
        """Trains on all terms; those of which neither weight nor factors leave zero beyond chance are not kept.

        A term enters with a weight when its texts' labels differ from what the machine expects of
        them by LEAST_GAIN, and with factors when the slope along them is LEAST_SLOPE standard
        deviations; then all are trained again, in ``rounds`` rounds at most. First weights are part of
        the log-odds of their term, the more the more texts have it, so words of a few copied texts gain
        no weight beside a telling one.
        """
        y = (np.asarray(y) > 0).astype(float)
        n = max(1, len(y))
        share = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        p = {"bias": np.array([np.log(share / (1 - share))])}
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(0, np.int64), p["bias"], np.zeros(0), np.zeros((0, factors)))
        # beyond this bound no slope can be so steep either
        least = min(least_texts(share, LEAST_GAIN), LEAST_SLOPE**2 * share * (1 - share) / max(share, 1 - share) ** 2)
        terms, rows, columns = incidence(texts, least)
        del texts
        m = len(terms)
        weight, v = np.zeros(m), np.random.default_rng(seed).normal(0, 0.02, (m, factors))
        active, logit = np.zeros(m, bool), np.full(n, p["bias"][0])
        for turn in range(rounds):
            chance = logistic(logit)
            new = (gains(y, chance, rows, columns, m) >= LEAST_GAIN) & ~active
            if not turn:
                positive, every = np.zeros(m), np.bincount(columns, minlength=m)
                np.add.at(positive, columns[(y > 0)[rows]], 1.0)
                weight = 0.5 * every / (every + 100) * (np.log((positive + 0.5) / (every - positive + 0.5)) - p["bias"][0])
            else:
                weight[new] = 0
                along, steep = pair_directions(y - chance, chance * (1 - chance), rows, columns, m, factors, seed + turn)
                paired = (steep >= LEAST_SLOPE) & ~active
                weight[paired & ~new] = 0
                v[paired] = 0.3 * along[paired]
                new |= paired
                if not new.any():
                    break
            active |= new
            own = np.cumsum(active) - 1
            inside = active[columns]
            r, c = rows[inside], own[columns[inside]]
            p |= {"weight": weight[active], "factors": v[active]}
            adam = Adam(0.05)
            for _ in range(steps):
                adam.step(p, cls(terms[active], p["bias"], p["weight"], p["factors"]).slopes(y, r, c, penalty))
            weight[active], v[active] = p["weight"], p["factors"]
            logit = cls(terms[active], p["bias"], p["weight"], p["factors"]).logits(r, c, n)[0]
        return cls(terms[active], p["bias"], p["weight"], p["factors"])

    def slopes(self, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, penalty: float) -> dict[str, np.ndarray]:
        """Slopes of the mean negative log-likelihood plus half the penalty times the squared factors."""
        n, m = len(y), len(self.terms)
        logit, sums = self.logits(rows, columns, n)
        r = (logistic(logit) - y) / n
        along = [np.bincount(columns, weights=r[rows] * (sums[rows, f] - self.factors[columns, f]), minlength=m) for f in range(self.factors.shape[1])]
        return {"bias": np.array([r.sum()]), "weight": np.bincount(columns, weights=r[rows], minlength=m), "factors": np.stack(along, axis=1) + penalty * self.factors}

    def logits(self, rows: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors
        sums = np.stack([np.bincount(rows, weights=v[columns, f], minlength=n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(rows, weights=(v * v).sum(axis=1)[columns], minlength=n)
        return self.bias[0] + np.bincount(rows, weights=self.weight[columns], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def _scores(model: FactorizationMachine):
    return lambda texts: logistic(model.logits(*select(*words_and_prefixes(texts), model.terms), len(texts))[0])


def _score(model: FactorizationMachine):
    score = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(part.column("text")))], ["doc_id", "score"])

    return run


def learn_toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 10_000, most_held: int = 8_000_000) -> FactorizationMachine:
    # the sample is held by what trains on it alone, and goes with it
    model = FactorizationMachine.fit(*labelled_sample(docs, labels, "toxic", train, sample, most_held, words_and_prefixes))
    release()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 10_000, most_held: int = 8_000_000) -> DataFrame:
    """Toxicity of every whole text of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Only labels for which ``train`` (a condition on doc_id) holds are learnt from: those of at
    most ``sample`` texts with ``most_held`` terms in all, chosen by a hash of doc_id, so that
    the driver trains in bounded memory. Inputs of a score are the text's words and word beginnings
    alone. Returns a row for each row: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts get the score of the bias, the share of toxic labels. Without labels
    nothing is predicted toxic; a score of exactly 0.5 is. Repeated rows score alike, null ids stay
    null, an empty table gives no rows.
    """
    model = learn_toxicity(docs, labels, train, sample, most_held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, **parameters) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all their columns.

    Null and empty texts are as likely toxic as the share of toxic labels; repeated rows and null ids
    stay or go by their text alone; an empty table stays empty.
    """
    score = _scores(learn_toxicity(docs, labels, train, **parameters))
    return keep_rows(docs, lambda texts: score(texts) < 0.5)
