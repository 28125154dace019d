"""The trees of many parses at once: walks, counts and lookups of learnt trees over the arrays of an Arrow batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than lists) and the flat values; null lists have none."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), lists.flatten()


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``count`` numbers from ``start`` on: the run of each number, and the numbers."""
    run = np.repeat(np.arange(len(start)), count)
    return run, np.arange(len(run)) + np.repeat(start - (np.cumsum(count) - count), count)


class Trees:
    """The tokens within ``depth`` of each row's token ``start`` (from 1), as ``pattern.walk`` finds them.

    Codes of a row, a path and a word for each token reached; ``paths`` and ``words`` are what they
    stand for, ``parents`` the path one step shorter. All rows are walked step by step together.
    """

    def __init__(self, batch: pa.RecordBatch, depth: int, free: tuple[str, ...]):
        (words_at, words), (at, heads), (labels_at, labels) = (flat(batch.column(c)) for c in ("words", "heads", "labels"))
        start = batch.column("start")
        if start.null_count or heads.null_count or not np.array_equal(at, labels_at):
            raise ValueError("a parse needs a head and a label for each token, and an object a start")
        start, head = start.to_numpy().astype(np.int64), heads.to_numpy().astype(np.int64)
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        label, names = encoded(labels)
        names = names.to_pylist()
        real = np.flatnonzero((head != 0) & np.array([n != "root" for n in names], bool)[label] if len(names) else head != 0)
        if ((head[real] < 0) | (head[real] > size[owner[real]])).any() or ((start < 1) | (start > size)).any():
            raise ValueError("a head or a start outside of its sentence")
        # both directions of every edge, in the order of their lower tokens
        top = at[owner[real]] + head[real] - 1
        source, target = (np.stack(pair, 1).ravel() for pair in ((top, real), (real, top)))
        step = (2 * label[real][:, None] + [0, 1]).ravel()
        order = np.argsort(source, kind="stable")
        target, step = target[order], step[order]
        first = np.searchsorted(source[order], np.arange(len(head) + 1))
        costs = np.repeat([n not in free for n in names], 2).astype(np.int64)

        seen = np.zeros(len(head), bool)
        cost, path = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        self.paths: list[list[str]] = [[]]
        parents, width = [0], max(2 * len(names), 1)
        front = at[:-1] + start - 1
        seen[front] = True
        reached = [front]
        while len(front):
            run, edge = runs(first[front], first[front + 1] - first[front])
            came, to, by = front[run], target[edge], step[edge]
            further = cost[came] + costs[by]
            near = np.flatnonzero(~seen[to] & (further <= depth))
            near = near[np.sort(np.unique(to[near], return_index=True)[1])]  # the first way found
            came, front, by = came[near], to[near], by[near]
            seen[front], cost[front] = True, further[near]
            new, which = np.unique(path[came] * width + by, return_inverse=True)
            path[front] = len(self.paths) + which
            for parent, b in (divmod(k, width) for k in new.tolist()):
                parents.append(parent)
                self.paths.append([*self.paths[parent], names[b // 2] + "><"[b % 2]])
            reached.append(front)
        token = np.concatenate(reached)
        coded, self.words = encoded(words)
        self.rows, self.row, self.path, self.parents = len(size), owner[token], path[token], np.array(parents)
        self.word = coded[words_at[self.row] + token - at[self.row]]

    def counts(self, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, path, word, n) of equal tokens; a row is its own group unless ``group`` gives one for each row."""
        of = self.row if group is None else group[self.row]
        p, w = len(self.paths), max(len(self.words), 1)
        key, n = np.unique((of * p + self.path) * w + self.word, return_counts=True)
        return key // (p * w), key // w % p, key % w, n

    def path_array(self, path: np.ndarray) -> pa.Array:
        return pa.array(self.paths, pa.list_(pa.string())).take(pa.array(path))

    def word_array(self, word: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(word))


def carried(batch: pa.RecordBatch, columns: list[str], row: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(row)) for c in columns]


class Learnt:
    """Learnt trees (relation, path as JSON, word, n) as sorted codes: what a batch has in common with them is looked up."""

    def __init__(self, table: pa.Table):
        (relation, relations), (path, paths), (word, words) = (encoded(pa.concat_arrays([pa.array([], pa.string()), *table.column(c).chunks])) for c in ("relation", "path", "word"))
        self.relations = relations
        self.paths = {tuple(json.loads(p)): i for i, p in enumerate(paths.to_pylist())}
        self.words = {w: i for i, w in enumerate(words.to_pylist())}
        key = (path * len(words) + word) * len(relations) + relation
        order = np.argsort(key)
        # a sentence has fewer words than any bound of 32 bits
        self.key, self.n = key[order], np.minimum(table.column("n").to_numpy(), 2**31 - 1).astype(np.int32)[order]

    def common(self, trees: Trees) -> tuple[np.ndarray, ...]:
        """(row, relation, path, word, n) of what the tree of each row and that of each relation both have, closed under prefixes; and each row's own number of words."""
        row, path, word, n = trees.counts()
        own = np.bincount(row, n, trees.rows).astype(np.int64)
        path_here = np.array([self.paths.get(tuple(p), -1) for p in trees.paths])[path]
        word_here = np.array([self.words.get(w, -1) for w in trees.words.to_pylist()], np.int64)[word]
        known = np.flatnonzero((path_here >= 0) & (word_here >= 0))
        r = max(len(self.relations), 1)
        key = (path_here[known] * max(len(self.words), 1) + word_here[known]) * r
        low = np.searchsorted(self.key, key)
        run, found = runs(low, np.searchsorted(self.key, key + r) - low)
        relation, hit = self.key[found] % r, known[run]
        row, path, word, n = row[hit], path[hit], word[hit], np.minimum(n[hit], self.n[found])
        # a path stays if all its prefixes are there, the shorter ones being known first
        p = len(trees.paths)
        there, at = np.unique((row * r + relation) * p + path, return_inverse=True)
        steps = np.array([len(x) for x in trees.paths])[there % p]
        parent = trees.parents[there % p]
        up = np.minimum(np.searchsorted(there, there - there % p + parent), max(len(there) - 1, 0))
        holds = there[up] == there - there % p + parent
        alive = steps == 0
        for k in range(1, int(steps.max(initial=0)) + 1):
            now = np.flatnonzero(steps == k)
            alive[now] = (parent[now] == 0) | (holds[now] & alive[up[now]])
        stay = alive[at]
        return row[stay], relation[stay], path[stay], word[stay], n[stay], own


def rows_of(batches: Iterator[pa.RecordBatch], depth: int, free: tuple[str, ...], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns, path, word and n of each row's tree."""
    for batch in batches:
        if batch.num_rows:
            trees = Trees(batch, depth, free)
            row, path, word, n = trees.counts()
            yield pa.RecordBatch.from_arrays([*carried(batch, keep, row), trees.path_array(path), trees.word_array(word), pa.array(n)], [*keep, "path", "word", "n"])


def merged_of(batches: Iterator[pa.RecordBatch], depth: int, free: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(relation, path, word, n) of all rows of a batch, added up."""
    for batch in batches:
        if batch.num_rows:
            trees = Trees(batch, depth, free)
            group, relations = encoded(batch.column("relation"))
            relation, path, word, n = trees.counts(group)
            yield pa.RecordBatch.from_arrays([relations.take(pa.array(relation)), trees.path_array(path), trees.word_array(word), pa.array(n)], ["relation", "path", "word", "n"])


def common_rows_of(batches: Iterator[pa.RecordBatch], depth: int, free: tuple[str, ...], learnt: Learnt, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns, relation, path, word and n of what each row has in common with each relation."""
    for batch in batches:
        if batch.num_rows:
            trees = Trees(batch, depth, free)
            row, relation, path, word, n, _ = learnt.common(trees)
            yield pa.RecordBatch.from_arrays([*carried(batch, keep, row), learnt.relations.take(pa.array(relation)), trees.path_array(path), trees.word_array(word), pa.array(n)], [*keep, "relation", "path", "word", "n"])


def common_sums_of(batches: Iterator[pa.RecordBatch], depth: int, free: tuple[str, ...], learnt: Learnt, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns, the words of each row's tree (own) and how many it has in common with which relation (common)."""
    for batch in batches:
        if batch.num_rows:
            trees = Trees(batch, depth, free)
            row, relation, _, _, n, own = learnt.common(trees)
            r = max(len(learnt.relations), 1)
            key, at = np.unique(row * r + relation, return_inverse=True)
            total = np.bincount(at, n, len(key)).astype(np.int64)
            offsets = np.searchsorted(key // r, np.arange(trees.rows + 1))
            pairs = pa.StructArray.from_arrays([learnt.relations.take(pa.array(key % r)), pa.array(total)], ["relation", "n"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], [*keep, "own", "common"])
