"""Language-model scoring with a weighted backoff automaton over smoothed word n-grams.

Training counts every n-gram of every training text. As such counts grow with the corpus, no
task or driver holds them all: texts are stored as chunks of word codes, each chunk asks for
its distinct n-grams (sorted 64-bit hashes, dealt into ranges of the hash space), a task for
each range adds up what the chunks counted and answers every chunk in the order it asked, and
from its answers a chunk builds the slice of the automaton that its texts can walk.

The automaton has a state for each history that occurs in training (the beginning of a text is
one), and the empty history. A state's arc for word w weighs log10 p(w | history) and leads to the
longest known history that ends in w; where w has no arc, the failure arc, of weight
log10(mu / (c(history) + mu)), leads to the history without its oldest word. Arcs hold
Dirichlet-smoothed probabilities (c(history w) + mu p(w | shorter)) / (c(history) + mu) over
the add-one unigrams, so all words and the end of a text sum to one in every state. mu is the
value of ``mus`` with the best leave-one-out likelihood over all training tokens.

A text is read from left to right once: the state is carried from word to word, and the weights
of the arcs and failure arcs taken add up to the text's log-probability. Many texts are read in step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import SPACE_BYTES, U64, Workspace, encode, hash_words, mix, slices, split_words

#: Distinct n-grams asked of one range of the hash space, about.
RANGE_SIZE = 2_000_000
#: Tasks that score chunks, at most.
MOST_PARTS = 100_000
END = mix(np.array([0x656E64], U64))[0]


def _planes(x: np.ndarray) -> bytes:
    """Numbers with all their first bytes first, then all second ones: the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


CHUNK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.binary())])

ASKED = pa.schema([("gram_order", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _chunk(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            at, flat = split_words(part.column("text"), SPACE_BYTES)
            codes, distinct = encode(flat)
            words = np.concatenate([[END], hash_words(distinct)]).astype(U64)
            lengths = np.diff(at) + 1
            ends = np.cumsum(lengths) - 1
            stream = np.zeros(int(lengths.sum()), np.uint32)
            inner = np.ones(len(stream), bool)
            inner[ends] = False
            stream[inner] = codes + 1
            row = {"doc_ids": part.column("doc_id").to_pylist(), "train": part.column("train").to_pylist(), "lengths": lengths.tolist(), "codes": _planes(stream), "words": words.tobytes()}
            yield pa.RecordBatch.from_pylist([row], CHUNK)

    return run


def _grams(row: dict, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-gram that ends at each token, for each order; whether a token trains; its place in its text; its word's code."""
    codes = _numbers(row["codes"], np.uint32)
    hashes = np.frombuffer(row["words"], U64)[codes]
    lengths = np.array(row["lengths"], np.int64)
    train = np.repeat(np.array(row["train"], bool), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = [hashes]
    for n in range(2, order + 1):
        # a text begins with the end mark, once; where an n-gram would reach before it there is none, and the shorter one's hash stands
        before = np.concatenate([np.full(n - 1, END, U64), hashes[: -(n - 1) or None]])[: len(hashes)]
        before = np.where(place == n - 2, END, before)
        gram = mix(grams[-1] ^ mix(before + U64(n)))
        grams.append(np.where(place >= n - 2, gram, grams[-1]))
    return grams, train, place, codes.astype(np.int64)


def _ask(order: int, bits: int):
    """A chunk's distinct n-grams with its own training counts, a row for each range of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams, train, *_ = _grams(row, order)
                out = {"gram_order": [], "range": [], "chunk": [], "hashes": [], "counts": []}
                for n, gram in enumerate(grams, 1):
                    distinct, which = np.unique(gram, return_inverse=True)
                    counts = np.bincount(which, weights=train, minlength=len(distinct)).astype(np.uint32)
                    part = (distinct >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
                    cut = np.flatnonzero(np.diff(part)) + 1
                    for a, b in zip([0, *cut], [*cut, len(distinct)], strict=True):
                        out["gram_order"].append(n)
                        out["range"].append(int(part[a]))
                        out["chunk"].append(row["chunk"])
                        out["hashes"].append(_planes(np.diff(distinct[a:b], prepend=U64(0))))
                        out["counts"].append(_planes(counts[a:b]))
                yield pa.RecordBatch.from_pydict(out, ASKED)

    return run


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Corpus counts for each chunk that asked, in its order; a row without a chunk has the number of distinct n-grams."""
    hashes = [np.cumsum(_numbers(x.as_py(), U64), dtype=U64) for x in asked.column("hashes")]
    counts = np.concatenate([_numbers(x.as_py(), np.uint32) for x in asked.column("counts")])
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
    answers = np.split(total[which], np.cumsum([len(h) for h in hashes])[:-1])
    n, part = key[0].as_py(), key[1].as_py()
    rows = len(answers) + 1
    return pa.table(
        {
            "gram_order": pa.array([n] * rows, pa.int32()), "range": pa.array([part] * rows, pa.int64()),
            "chunk": pa.concat_arrays([*asked.column("chunk").chunks, pa.array([None], pa.int64())]),
            "counts": pa.array([*(_planes(a) for a in answers), None], pa.binary()),
            "known": pa.array([None] * (rows - 1) + [int((total > 0).sum())], pa.int64()),
        }
    )


#: Tokens of a text that are read in a row; where a longer text is taken up again, the words before set the state.
STRETCH = 256


class Slice:
    """Training counts of all n-grams that a chunk's tokens end, and of the histories before them."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], place: np.ndarray, codes: np.ndarray, texts: int):
        """counts[n - 1]: of each distinct n-gram, in the order of np.unique."""
        self.place, self.codes, self.texts, self.order = place, codes, texts, len(grams)
        found = [np.unique(g, return_index=True, return_inverse=True) for g in grams]
        #: first token that ends each n-gram, and the n-gram that each token ends
        self.first, self.gram = [f[1] for f in found], [f[2] for f in found]
        self.count = counts

    def at_tokens(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: whether it ends an n-gram, its count, and how often its history was left in training (n from 2)."""
        left = np.zeros(len(self.codes), np.int64)
        left[1:] = self.count[n - 2][self.gram[n - 2][:-1]]
        if n == 2:
            left[self.place == 0] = self.texts
        there = self.place >= n - 2
        return there, self.count[n - 1][self.gram[n - 1]], np.where(there, left, 0)

    def left_out(self, mu: float, train: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
        """log10 probability of each training token by counts without its own occurrence; 0 for other tokens."""
        less = train.astype(np.int64)
        p = (self.count[0][self.gram[0]] - less + 1) / (tokens + vocabulary + 1 - less)
        for n in range(2, self.order + 1):
            there, arc, left = self.at_tokens(n)
            p = np.where(there & (left - less > 0), (arc - less + mu * p) / np.maximum(left - less + mu, mu), p)
        return np.where(train, np.log10(p), 0.0)


class BackoffAutomaton:
    """States, arcs and failure arcs for the words of a chunk, with weights for each mu.

    State 0 is the empty history, state 1 the beginning of a text. An arc's key is its state and its
    word in one number; keys are sorted. Every word has an arc from the empty history.
    """

    def __init__(self, known: Slice, tokens: int, vocabulary: int, mus: tuple[float, ...]):
        mu = np.array(mus)
        self.words = int(known.codes.max(initial=0)) + 1
        self.order = known.order
        left, failure = [np.array([0, known.texts if known.order > 1 else 0])], [np.zeros(2, np.int64)]
        states: list[np.ndarray] = []  # of each order's n-grams the state in which it is the history, or 0
        made = 2
        for n in range(1, known.order):
            first, count = known.first[n - 1], known.count[n - 1]
            history = (count > 0) & (known.codes[first] > 0) & (known.place[first] >= n - 2)
            states.append(np.where(history, made + np.cumsum(history) - 1, 0))
            made += int(history.sum())
            left.append(count[history])
            failure.append(states[n - 2][known.gram[n - 2][first[history]]] if n > 1 else np.zeros(int(history.sum()), np.int64))
        self.failure = np.concatenate(failure)
        left = np.concatenate(left)
        self.failure_weight = np.log10(mu / (left[:, None] + mu))

        def after(n: int, first: np.ndarray) -> np.ndarray:
            """The state in which the n words that end at a token are the history; a text's end begins the next."""
            return np.where(known.codes[first] > 0, states[n - 1][known.gram[n - 1][first]] if n else 0, 1)

        first = known.first[0]
        p = ((known.count[0] + 1) / (tokens + vocabulary + 1))[:, None] * np.ones(len(mu))
        keys, weights, ends = [known.codes[first]], [p], [after(min(1, known.order - 1), first)]
        for n in range(2, known.order + 1):
            there, _, _ = known.at_tokens(n)
            first, count = known.first[n - 1], known.count[n - 1]
            kept = (count > 0) & there[first]
            first, whole = first[kept], np.zeros((len(count), len(mu)))
            history = np.where(known.place[first] == 0, 1, states[n - 2][known.gram[n - 2][first - 1]])
            whole[kept] = (count[kept][:, None] + mu * p[known.gram[n - 2][first]]) / (left[history][:, None] + mu)
            keys.append(history * self.words + known.codes[first])
            weights.append(whole[kept])
            ends.append(after(min(n, known.order - 1), first))
            p = whole
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.weights, self.ends = keys[order], np.log10(np.concatenate(weights)[order]), np.concatenate(ends)[order]
        self.failures = 0

    def read(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, for each mu."""
        start = np.cumsum(lengths) - lengths
        parts = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        # a stretch is taken up with the words before it, which weigh nothing there
        warm = np.minimum(nth * STRETCH, self.order - 1)
        length = np.minimum(STRETCH, lengths[text] - nth * STRETCH) + warm
        begin = start[text] + nth * STRETCH - warm
        by_length = np.argsort(-length, kind="stable")
        text, warm, length, begin = text[by_length], warm[by_length], length[by_length], begin[by_length]
        state = np.where(begin == start[text], 1, 0)
        total = np.zeros((len(text), self.weights.shape[1]))
        reading = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for step, live in enumerate(reading.tolist()):
            word, now = codes[begin[:live] + step], state[:live]
            counts = step >= warm[:live]
            failed = np.arange(live)
            arc = np.empty(live, np.int64)
            while len(failed):
                key = now[failed] * self.words + word[failed]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                arc[failed] = at
                failed = failed[self.keys[at] != key]
                self.failures += int(counts[failed].sum())
                total[failed] += np.where(counts[failed, None], self.failure_weight[now[failed]], 0)
                now[failed] = self.failure[now[failed]]
            total[:live] += np.where(counts[:, None], self.weights[arc], 0)
            state[:live] = self.ends[arc]
        out = np.zeros((len(lengths), total.shape[1]))
        # a text's stretches are added in order
        for part in range(int(parts.max(initial=0))):
            mine = np.flatnonzero(nth[by_length] == part)
            out[text[mine]] += total[mine]
        return out


def _score(order: int, tokens: int, vocabulary: int, texts: int, mus: tuple[float, ...]):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64()))])

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        row = chunk.to_pylist()[0]
        grams, train, place, codes = _grams(row, order)
        got = answers.sort_by([("gram_order", "ascending"), ("range", "ascending")])
        orders = got.column("gram_order").to_numpy()
        counts = [np.concatenate([_numbers(x.as_py(), np.int64) for x in got.column("counts").filter(pa.array(orders == n))]) for n in range(1, order + 1)]
        known = Slice(grams, counts, place, codes, texts)
        lengths = np.array(row["lengths"], np.int64)
        start = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, start)
        seen = counts[0][known.gram[0]]
        scores = BackoffAutomaton(known, tokens, vocabulary, mus).read(codes, lengths)
        own = np.stack([add(known.left_out(mu, train, tokens, vocabulary)) for mu in mus], axis=1)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([not t for t in row["train"]], pa.bool_()),
                "n_tokens": pa.array(row["lengths"], pa.int64()), "n_known": add((seen > 0).astype(np.int64)), "base_score": add(np.log10((seen + 1) / (tokens + (vocabulary + 1)))),
                "scores": pa.array(list(scores), pa.list_(pa.float64())), "left_out": pa.array(list(own), pa.list_(pa.float64())),
            },
            schema=schema,
        )

    return run


def score_language_model(
    docs: DataFrame, train: Column, order: int = 2, mus: tuple[float, ...] = (2.0, 8.0, 32.0, 128.0, 512.0, 2048.0), chunk_bytes: int = 8 << 20
) -> DataFrame:
    """Log10 probability of every whole text under a model trained on the rows where ``train`` holds.

    Takes doc_id and text; ``train`` is a condition on the columns of ``docs``. Tokens: words
    between white space, A-Z lower-cased, then one end. Returns a row for each row: doc_id,
    held_out (not trained on), n_tokens, n_known (tokens seen in training), train_tokens (all
    tokens of training), base_score (add-one unigrams), score (the automaton).

    Null and empty texts are one end token. Null ids stay null; repeated rows count and are
    scored each. Without training rows every state is empty and both scores are of a uniform
    choice among one word. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "language-model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = rows.mapInArrow(_chunk(chunk_bytes), "doc_ids array<long>, train array<boolean>, lengths array<long>, codes binary, words binary")
    chunks = space.save(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    flags = F.explode(F.arrays_zip("train", "lengths")).alias("z")
    seen = chunks.select(flags).agg(F.sum("z.lengths"), F.sum(F.when(F.col("z.train"), F.col("z.lengths"))), F.count_if("z.train")).first()
    tokens, train_tokens, texts = (x or 0 for x in seen)
    bits = max(0, math.ceil(math.log2(max(1, tokens / RANGE_SIZE))))
    asked = chunks.select("chunk", "train", "lengths", "codes", "words").mapInArrow(_ask(order, bits), "gram_order int, range long, chunk long, hashes binary, counts binary")
    answers = asked.repartition(max(12, order * 2**bits), "gram_order", "range").groupBy("gram_order", "range")
    answers = space.save(answers.applyInArrow(_answer, "gram_order int, range long, chunk long, counts binary, known long"), "answers")
    vocabulary = answers.filter("gram_order = 1 and known is not null").agg(F.sum("known")).first()[0] or 0
    # a chunk is a bounded piece of work, however many there are
    parts = max(12, min(MOST_PARTS, chunks.count()))
    slices_of = answers.filter("chunk is not null").select("chunk", "gram_order", "range", "counts").repartition(parts, "chunk").groupBy("chunk")
    scored = chunks.select("chunk", "doc_ids", "train", "lengths", "codes", "words").repartition(parts, "chunk").groupBy("chunk").cogroup(slices_of)
    scored = scored.applyInArrow(
        _score(order, train_tokens, vocabulary, texts, mus),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>",
    )
    scored = space.save(scored, "scored")
    fit = scored.agg(*(F.sum(F.col("left_out")[i]) for i in range(len(mus)))).first()
    best = max(range(len(mus)), key=lambda i: fit[i] if fit[i] is not None else 0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), F.lit(float(mus[best])).alias("mu"))
