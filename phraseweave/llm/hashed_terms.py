"""Texts as sets of hashed terms, a bounded sample of labelled texts to learn from, and which terms a model has.

A model may have any term of the sample. It has those that tell: beyond chance, the sum of its errors
over the texts with the term isn't zero. As errors change when the model has more terms, terms
enter in rounds, until none does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseweave.llm.common import WORD_BYTES, Workspace, encode, hash_words, release, slices, split_words

#: Entries of a sample that are worked on at once.
PIECE = 1 << 19
#: Terms are hashed to so many bits: collisions between a text's terms and telling ones stay rare.
BITS = 31
#: Reads texts, gives rows (ascending) and hashed terms of their distinct terms.
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def distinct_pairs(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(rows.astype(np.int64) << BITS | terms)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def words_and_prefixes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and their first four and five letters as terms of their own."""
    at, flat = split_words(texts, WORD_BYTES)
    codes, words = encode(flat)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    rows, codes = (x.astype(np.int64) for x in divmod(np.unique(rows * max(1, len(words)) + codes), max(1, len(words))))
    columns = [place(hash_words(words))]
    for n in (4, 5):
        cut, parts = encode(pc.binary_join_element_wise(str(n), pc.utf8_slice_codeunits(words, 0, n), "^"))
        columns.append(place(hash_words(parts))[cut])
    return distinct_pairs(np.tile(rows, 3), np.concatenate([c[codes] for c in columns]))


def _features(read: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, terms = read(part.column("text"))
            cut = np.searchsorted(rows, np.arange(1, part.num_rows))
            sets = np.split(terms.astype(np.int32), cut)
            yield pa.RecordBatch.from_arrays([part.column("nth"), part.column("label"), pa.array([len(t) for t in sets], pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())], ["nth", "label", "size", "terms"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, most: int, most_held: int, read: Reader) -> tuple[list[int], list[np.ndarray]]:
    """Labels and hashed terms of at most ``most`` labelled texts, the same choice at any partitioning.

    Rows of ``labels`` (doc_id, ``column``) without id or label are left out; an id with several
    labels has the largest. ``train`` is a condition on doc_id. At most ``most`` ids are sent to
    executors, and to the driver as many of their texts, in the order of the choice, as have
    ``most_held`` terms together (four bytes each).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # labels of documents that are not here any more don't use up the bound
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id").alias("nth")).orderBy("nth", "doc_id").limit(most)
    space = Workspace(docs.sparkSession, "labelled")
    found = space.save(texts.join(F.broadcast(chosen), "doc_id").select("nth", "label", "text").mapInArrow(_features(read), "nth long, label int, size long, terms binary"), "terms")
    # rows that repeat an id come once for each text of theirs; no more rows than the bound
    upto = Window.orderBy("nth", "size", F.xxhash64("terms")).rowsBetween(Window.unboundedPreceding, 0)
    found = found.groupBy("nth", "label", "size", "terms").count().drop("count").orderBy("nth", "size", F.xxhash64("terms")).limit(most)
    held = found.withColumn("held", F.sum("size").over(upto)).filter(F.col("held") <= most_held).select("label", "terms").toArrow()
    # copies say the same once
    label_of = dict(zip(held.column("terms").to_pylist(), held.column("label").to_pylist(), strict=True))
    del held
    release()
    order = sorted(label_of, key=lambda terms: (label_of[terms], terms))
    return [label_of[t] for t in order], [np.frombuffer(t, np.int32) for t in order]


def incidence(texts: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that at least ``least`` texts have, sorted; and rows and columns of the texts' terms among them."""
    flat = np.concatenate([*texts, np.zeros(0, np.int32)])
    flat.sort()
    first = np.flatnonzero(np.diff(flat, prepend=np.int32(-1))).astype(np.int32)
    terms = flat[first[np.diff(first, append=np.int32(len(flat))) >= least]]
    del flat, first
    none = np.zeros(0, np.int32)
    columns = [select(none, t, terms)[1].astype(np.int32) for t in texts]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in columns])
    return terms.astype(np.int64), rows, np.concatenate([*columns, none])


def least_texts(share: float, least_gain: float) -> float:
    """In fewer texts a term can't reach the gain, whatever their labels: leaving it out changes no choice."""
    rarest = min(max(min(share, 1 - share), 1e-9), 0.5)
    return least_gain / (-2 * np.log(rarest))


def gains(y: np.ndarray, chance: np.ndarray, rows: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of each term: its texts' positive labels against those that the model expects (chance of each text)."""
    n, positive, expected = np.zeros(m), np.zeros(m), np.zeros(m)
    for i in range(0, len(rows), PIECE):  # in pieces, as the driver's memory is small
        r, c = rows[i : i + PIECE], columns[i : i + PIECE]
        n += np.bincount(c, minlength=m)
        positive += np.bincount(c, weights=y[r], minlength=m)
        expected += np.bincount(c, weights=chance[r], minlength=m)

    def part(seen: np.ndarray, thought: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(thought, 1e-300)), 0)

    return 2 * (part(positive, expected) + part(n - positive, n - expected))


def pair_directions(error: np.ndarray, spread: np.ndarray, rows: np.ndarray, columns: np.ndarray, m: int, factors: int, seed: int, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the terms' factors along which the likelihood is steepest, and how steep in standard deviations (largest of all factors).

    From factors near zero the slope along v_i is the sum over texts of error times the other
    terms' factors: following it is power iteration on the terms' pairwise sums of errors, so pairs come
    up that tell together though neither term tells alone. spread: variance of each text's label.
    """
    v = np.random.default_rng(seed).normal(size=(m, factors))
    steep = np.zeros((m, factors))
    if not m:
        return v, np.zeros(0)
    for _ in range(turns):
        for f in range(factors):
            pieces = [(rows[i : i + PIECE], columns[i : i + PIECE]) for i in range(0, len(rows), PIECE)]
            whole, slope, chance = np.zeros(len(error)), np.zeros(m), np.zeros(m)
            for r, c in pieces:
                whole += np.bincount(r, weights=v[c, f], minlength=len(error))
            for r, c in pieces:
                others = whole[r] - v[c, f]
                slope += np.bincount(c, weights=error[r] * others, minlength=m)
                chance += np.bincount(c, weights=spread[r] * others * others, minlength=m)
            steep[:, f] = slope / np.sqrt(np.maximum(chance, 1e-12))
        v = steep * steep * steep
        if factors > 1 and m >= factors:
            v = np.linalg.qr(v / np.maximum(np.abs(v).max(axis=0), 1e-300))[0]
        v = v / np.maximum(np.abs(v).max(axis=0), 1e-300)
    return v, np.abs(steep).max(axis=1, initial=0)


def select(rows: np.ndarray, found: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of terms found in rows (or in no rows in particular) those that are among ``terms``, by their place there."""
    if not len(terms):
        return rows[:0], np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    hit = terms[at] == found
    return rows[hit] if len(rows) else rows, at[hit]


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(keep(part.column("text"))))

    return docs.mapInArrow(run, docs.schema)


class Adam:
    """Adam over named arrays."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, values: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in slopes.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            values[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
