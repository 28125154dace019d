"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Plan: (1) one pass over the texts gives each document the key of its shingle set and, for each
tree of the forest, its signature: a path of MinHash values. Documents with equal sets become
one node. (2) Sorting a tree's signatures lays its prefix trie out in order: neighbours share
their longest common prefix, and a run of neighbours that share d levels is the trie's
subtree at depth d. (3) Matched prefixes start as whole paths and are shortened, always
in the tree where that brings the fewest new matches for the recall that it gains, until a pair
at the threshold matches in some tree with the target probability. Trees that the data make
dense so keep long prefixes. (4) Nodes hang on the first one of their run; the
components of these edges hold every candidate pair without listing pairs. (5) The shingle sets of
a component are dealt into blocks of bounded size, sorted by set size; blocks whose sizes allow a
match are compared by an exact count of common shingles. Only the number of links and one edge for
each node leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseweave.llm.common import U64, WORD_BYTES, Workspace, binaries, encode, hash_words, mix, ratio, slices, split_words
from phraseweave.llm.components import connected_components

#: Weight of a block: shingles, and for each node a constant.
BLOCK_WEIGHT, NODE_WEIGHT = 150_000, 200
#: Blocks of a component that a task compares with later ones.
BLOCKS_A_SLOT = 8
#: Levels of a signature: 16 bits each, in two words.
DEEPEST = 8
#: A key with more than this share of all rows is joined by broadcast; there are at most 1 / share.
HOT_SHARE = 0.001


def matched_depth(threshold: float, trees: int, max_depth: int, target_recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree often enough, if all trees have the same."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target_recall:
            return depth
    return 1


def shortened(matches: np.ndarray, threshold: float, least: int, target_recall: float) -> list[int]:
    """Depth of the matched prefix in each tree. matches[t, d]: neighbours of tree t that share d levels or more."""
    trees, deepest = len(matches), matches.shape[1] - 1
    depths, missed = [deepest] * trees, lambda d: np.log1p(-(threshold**d))
    while sum(missed(d) for d in depths) > np.log(max(1 - target_recall, 1e-300)):
        prices = [((1 + matches[t, d - 1] - matches[t, d]) / (missed(d) - missed(d - 1)), t) for t, d in enumerate(depths) if d > least]
        if not prices:
            break
        depths[min(prices)[1]] -= 1
    return depths


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words; a shorter text is one run, an empty one none."""
    at, flat = split_words(texts, WORD_BYTES)
    codes, distinct = encode(flat)
    words = hash_words(distinct)[codes] if len(codes) else np.zeros(0, U64)
    odd = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    runs = np.zeros(max(0, len(words) - n + 1), U64)
    for j in range(n):
        runs += words[j : j + len(runs)] * odd[j]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(words[a:b] * odd[: b - a]) + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def signature(shingles: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """For each tree two words: the path of its MinHash values, 16 bits a level."""
    draw = np.random.default_rng(seed)
    mult = draw.integers(1, 2**32, trees * DEEPEST, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = draw.integers(0, 2**32, trees * DEEPEST, dtype=np.uint64).astype(np.uint32)
    small = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(trees * DEEPEST, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(small), 128):
        m = np.multiply.outer(small[i : i + 128], mult)
        m += add
        np.minimum(low, m.min(axis=0), out=low)
    # least values begin with zeros: their bits are spread before they are cut
    levels = (mix(low.astype(U64)) >> U64(48)).reshape(2 * trees, DEEPEST // 2)
    return levels[:, 0] << U64(48) | levels[:, 1] << U64(32) | levels[:, 2] << U64(16) | levels[:, 3]


def _sign(n: int, trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), n)
            full = [len(s) > 0 for s in sets]
            keys = pa.array(np.array([set_key(s) for s in sets], U64).view(np.int64), mask=~np.array(full))
            paths = pa.array([signature(s, trees, seed).tobytes() if f else None for s, f in zip(sets, full, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), keys, paths], ["doc_id", "tag", "key", "paths"])

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of a node's signature."""
    for batch in batches:
        for part in slices([batch], "paths", 1 << 20):
            paths = np.frombuffer(b"".join(part.column("paths").to_pylist()), np.int64).reshape(part.num_rows, -1, 2)
            trees = paths.shape[1]
            flat = paths.reshape(-1, 2)
            columns = [np.tile(np.arange(trees, dtype=np.int32), part.num_rows), np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]), np.repeat(part.column("key").to_numpy(), trees)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "high", "low", "key"])


def common_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading levels that paths (two words a row) share."""
    differ = a ^ b
    same = sum((differ < U64(1 << bits)).astype(np.int64) for bits in (48, 32, 16, 0))
    return same[:, 0] + np.where(same[:, 0] == DEEPEST // 2, same[:, 1], 0)


NEIGHBOURS = "tree int, levels int, key long, heads array<long>, part int, high long, low long"


def _neighbours(least: int):
    """Of sorted signatures: each that shares ``least`` levels or more with the one before, with the first of its run at each depth from there.

    A task's first and last signature come as well (with part, high and low), to be compared across tasks.
    """
    names, depths = [c.split()[0] for c in NEIGHBOURS.split(", ")], range(least, DEEPEST + 1)

    def bound(part: int, tree: int, path: np.ndarray, key: int) -> pa.RecordBatch:
        values = [tree, -1, key, None, part, *path.view(np.int64).tolist()]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[int, np.ndarray, int] | None = None
        heads = np.zeros(len(depths), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, key = batch.column("tree").to_numpy(), batch.column("key").to_numpy()
            paths = np.stack([batch.column(c).to_numpy().view(U64) for c in ("high", "low")], axis=1)
            if last is None:
                yield bound(part, int(tree[0]), paths[0], int(key[0]))
            before = np.concatenate([(last[1] if last else ~paths[0])[None, :], paths[:-1]])
            levels = np.where(np.concatenate([[last[0] if last else -1], tree[:-1]]) == tree, common_levels(before, paths), 0)
            first = np.empty((len(key), len(depths)), np.int64)
            for j, depth in enumerate(depths):
                at = np.maximum.accumulate(np.where(levels < depth, np.arange(len(key)), -1))
                first[:, j] = np.where(at < 0, heads[j], key[at])
            heads, last = first[-1].copy(), (int(tree[-1]), paths[-1].copy(), int(key[-1]))
            hit = np.flatnonzero(levels >= least)
            offsets = pa.array(np.arange(len(hit) + 1, dtype=np.int32) * len(depths))
            none = [pa.nulls(len(hit), t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(tree[hit]), pa.array(levels[hit].astype(np.int32)), pa.array(key[hit]), pa.ListArray.from_arrays(offsets, pa.array(first[hit].ravel())), *none], names)
        if last is not None:
            yield bound(part, *last)

    return run


def _across_tasks(bounds: list, least: int) -> list[tuple]:
    """The same for the first signature of each task and the last one of the task before."""
    ends: dict[int, list] = {}
    for row in bounds:
        ends.setdefault(row["part"], []).append((row["tree"], np.array([[row["high"], row["low"]]], np.int64).view(U64), row["key"]))
    found = []
    # a task's two come sorted: the first one has the smaller path, as signed words
    order = lambda x: (x[0], *x[1].view(np.int64)[0].tolist(), x[2])
    parts = [sorted(ends[p], key=order) for p in sorted(ends)]
    for (_, before), (after, _) in zip(parts[:-1], parts[1:], strict=True):
        levels = int(common_levels(before[1], after[1])[0]) if before[0] == after[0] else 0
        if levels >= least:
            found.append((after[0], levels, after[2], [before[2]] * (DEEPEST + 1 - least)))
    return found


def candidate_edges(nodes: DataFrame, trees: int, threshold: float, target_recall: float, space: Workspace) -> DataFrame:
    """(src, dst) that join the nodes (key, paths) of every run of the forest, at the depths to which its prefixes are shortened."""
    least = max(1, matched_depth(threshold, trees, DEEPEST, target_recall) - 2)
    leaves = nodes.select("key", "paths").mapInArrow(_leaves, "tree int, high long, low long, key long")
    order = ["tree", "high", "low", "key"]
    leaves = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    found = space.save(leaves.mapInArrow(_neighbours(least), NEIGHBOURS), "neighbours")
    bounds = found.filter("part is not null").select("part", "tree", "high", "low", "key").collect()  # two rows for each task of the sort
    across = nodes.sparkSession.createDataFrame(_across_tasks(bounds, least), "tree int, levels int, key long, heads array<long>")
    found = found.filter("part is null").select("tree", "levels", "key", "heads").union(across)
    matches = np.zeros((trees, DEEPEST + 1), np.int64)
    for row in found.groupBy("tree", "levels").count().collect():  # a row for each tree and depth
        matches[row["tree"], : row["levels"] + 1] += row["count"]
    depths = shortened(matches, threshold, least, target_recall)
    depth = F.get(F.array(*map(F.lit, depths)), F.col("tree"))
    return found.filter(F.col("levels") >= depth).select(F.col("key").alias("src"), F.get("heads", depth - least).alias("dst"))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), n)
            mine = np.array([set_key(s) if len(s) else 0 for s in sets], U64).view(np.int64)
            # another row may carry the same doc_id with another text
            keep = [i for i, k in enumerate(part.column("key").to_pylist()) if len(sets[i]) and mine[i] == k]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(keep, pa.int64())), pa.array([len(sets[i]) for i in keep], pa.int64()), binaries([sets[i] for i in keep])],
                ["key", "size", "shingles"],
            )

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between sets of a and b (of a with itself if b is None)."""
    all_sets = a + (b or [])
    flat = np.concatenate(all_sets)
    owner = np.repeat(np.arange(len(all_sets)), [len(s) for s in all_sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.concatenate([start, [len(flat)]]))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(a), len(b) if b is not None else len(a)), np.int64)
    wide = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, wide, 8192):
        low, high = np.searchsorted(column, [c, c + 8192])
        m = np.zeros((len(all_sets), min(8192, wide - c)), np.float32)
        m[owner[low:high], column[low:high] - c] = 1
        out += (m[: len(a)] @ (m[len(a) :] if b is not None else m).T).astype(np.int64)
    return out


def _roots(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and of columns: equal for what the links join within this block or pair of blocks."""
    rows, columns = near.shape
    far = rows + columns
    row, column = np.arange(rows), np.arange(rows, far)
    while True:
        low = np.minimum(column, np.where(near, row[:, None], far).min(axis=0, initial=far))
        new = np.minimum(row, np.where(near, low, far).min(axis=1, initial=far))
        if (low == column).all() and (new == row).all():
            return row, column
        row, column = new, low


def _links(near: np.ndarray, keys: list[np.ndarray], copies: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(key, linked documents, root) of each row and column that has a link; keys and copies: of rows, of columns."""
    all_keys = np.concatenate(keys)
    out = []
    for labels, side, links in zip(_roots(near), (0, 1), (near @ copies[1], near.T @ copies[0]), strict=True):
        for i in np.flatnonzero(links):
            out.append((int(keys[side][i]), int(links[i]), int(all_keys[labels[i]])))
    return out


def _links_within(near: np.ndarray, keys: np.ndarray, copies: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for one block against itself, where every node is near itself and that isn't a link."""
    np.fill_diagonal(near, True)
    links = near @ copies - copies
    labels, _ = _roots(near)
    return [(int(keys[i]), int(links[i]), int(keys[labels[i]])) for i in np.flatnonzero(links)]


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, copies, sizes = (np.frombuffer(row[c], np.int64) for c in ("keys", "copies", "sizes"))
    return keys, copies, np.split(np.frombuffer(row["shingles"], U64), np.cumsum(sizes)[:-1])


def _found(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["key", "links", "root"])


def _near(top: int, below: int, common: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    sizes = np.add.outer([len(s) for s in a], [len(s) for s in b])
    return (common > 0) & (common * (below + top) >= top * sizes)


BLOCK = pa.schema([("component", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.binary()), ("copies", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, size and key in blocks of bounded weight, numbered in order; a row for each block."""
    names = ["component", "key", "copies", "size", "shingles"]
    number = TaskContext.get().partitionId() << 33

    def close(group: list[tuple]) -> dict:
        keys, copies, sizes = (np.array([g[i] for g in group], np.int64) for i in (1, 2, 3))
        return {"component": group[0][0], "block": number, "low": int(sizes.min()), "high": int(sizes.max()), "keys": keys.tobytes(), "copies": copies.tobytes(), "sizes": sizes.tobytes(), "shingles": b"".join(g[4] for g in group)}

    group: list[tuple] = []
    ready: list[dict] = []
    weight = held = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if group and (group[0][0] != row[0] or weight >= BLOCK_WEIGHT):
                ready.append(close(group))
                number, held, group, weight = number + 1, held + len(ready[-1]["shingles"]), [], 0
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(ready, BLOCK)
                    ready, held = [], 0
            group.append(row)
            weight += row[3] + NODE_WEIGHT
    if group:
        ready.append(close(group))
    if ready:
        yield pa.RecordBatch.from_pylist(ready, BLOCK)


def _within(top: int, below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, copies, sets = _unpack(batch.slice(i, 1).to_pylist()[0])
                near = _near(top, below, _common(sets, None), sets, sets)
                yield _found(_links_within(near, keys, copies))

    return run


def _across(top: int, below: int):
    names = ("keys", "copies", "sizes", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ka, ca, a = _unpack(row)
                kb, cb, b = _unpack({n: row[f"other_{n}"] for n in names})
                near = _near(top, below, _common(a, b), a, b)
                yield _found(_links(near, [ka, kb], [ca, cb]))

    return run


def _joined(docs: DataFrame, words: int, threshold: float, trees: int, target_recall: float, seed: int) -> DataFrame:
    """For each row of ``docs``: doc_id, tag (a hash of the text), label (the same for all of a group, null without words), class_id, copy_id, n_links."""
    space = Workspace(docs.sparkSession, "jaccard")
    top, below = ratio(threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    signed_rows = space.save(rows.mapInArrow(_sign(words, trees, seed), "doc_id long, tag long, key long, paths binary"), "signed")
    # the row whose text stands for the set
    model = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tag")).alias("model")
    nodes = signed_rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), model, F.first("paths").alias("paths"))
    nodes = space.save(nodes, "nodes")
    candidates = connected_components(candidate_edges(nodes, trees, threshold, target_recall, space), space)

    wanted = space.keep(candidates.join(nodes.drop("paths"), candidates["node"] == nodes["key"]).select("key", "model", "copies", "component"))
    # one plan at every size: the texts are shuffled once, whether or not the other side could be broadcast
    told = wanted.select("key", F.col("model.id").alias("id"), F.col("model.tag").alias("model_tag")).hint("merge")
    texts = rows.join(told, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["tag"] == F.col("model_tag"))).select("key", "text")
    sets = space.save(texts.mapInArrow(_sets(words), "key long, size long, shingles binary").dropDuplicates(["key"]), "sets")
    order = ["component", "size", "key"]
    placed = sets.join(wanted.select("key", "copies", "component"), "key").select(*order, "copies", "shingles").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = space.save(placed.mapInArrow(_pack, "component long, block long, low long, high long, keys binary, copies binary, sizes binary, shingles binary"), "blocks")
    found = "key long, links long, root long"
    links = blocks.mapInArrow(_within(top, below), found)
    links = space.keep(links.union(_block_pairs(blocks, top, below).mapInArrow(_across(top, below), found)))
    groups = space.keep(connected_components(links.select(F.col("key").alias("src"), F.col("root").alias("dst")), space))
    per_node = links.groupBy("key").agg(F.sum("links").alias("links"))
    class_of = space.keep(groups.join(nodes.select("key", "copy_id"), groups["node"] == nodes["key"]).groupBy("component").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("members")))
    bound = max(1.0, HOT_SHARE * signed_rows.count())
    classed = _joined_hot(groups, class_of, "component", "members", bound).select(F.col("node").alias("key"), F.col("component").alias("label"), "class_id")
    whole = nodes.select("key", "copy_id", "copies").join(per_node, "key", "left").join(classed, "key", "left")
    whole = whole.select("key", "copies", "copy_id", F.coalesce("label", "key").alias("label"), F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = space.keep(whole)
    return _joined_hot(signed_rows.select("doc_id", "tag", "key"), whole, "key", "copies", bound).select(
        "doc_id",
        "tag",
        "label",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _joined_hot(left: DataFrame, right: DataFrame, key: str, size: str, bound: float) -> DataFrame:
    """Left join with a table of one row a key that says how many rows the left has of it: keys with more than the bound by broadcast, the others by a shuffle.

    Where the bound is a share of all rows, there are no more such keys than its inverse. Rows without key stay.
    """
    known = left.join(F.broadcast(right.filter(F.col(size) > bound)), key, "left")
    rest = known.filter(F.col(size).isNull() & F.col(key).isNotNull()).select(*left.columns).join(right.filter(F.col(size) <= bound), key)
    return known.filter(F.col(size).isNotNull() | F.col(key).isNull()).unionByName(rest)


def _block_pairs(blocks: DataFrame, top: int, below: int) -> DataFrame:
    """Pairs of blocks of a component that set sizes allow to match, dealt so that no task has all of a large component."""
    at = blocks.select("component", "block", "low", "high").withColumn("nth", F.row_number().over(Window.partitionBy("component").orderBy("block")) - 1)  # a row for each block
    at = at.withColumn("slot", F.floor(F.col("nth") / BLOCKS_A_SLOT).cast("long"))
    slots = at.groupBy("component", "slot").agg(F.max("high").alias("most"))
    # blocks are in order of set size: a pair of sets at the threshold can't be further apart than this
    reach = at.select("component", "block", "low", F.col("slot").alias("own")).join(slots, "component").filter((F.col("slot") <= F.col("own")) & (F.col("low") * top <= F.col("most") * below))
    left = blocks.join(at.select("block", "slot"), "block")
    other = blocks.join(reach.select("block", "slot"), "block")
    other = other.select("component", "slot", *(F.col(c).alias(f"other_{c}") for c in blocks.columns if c != "component"))
    return left.join(other, ["component", "slot"]).filter((F.col("block") < F.col("other_block")) & (F.col("other_low") * top <= F.col("high") * below))


def jaccard_join(docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 32, target_recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """Every link between documents whose sets of ``words``-word runs have a Jaccard index of ``threshold`` or more.

    Takes doc_id (long) and text (string); other columns are ignored. Returns a row for each
    row of ``docs``: doc_id, class_id (smallest doc_id of its group of documents that links
    join, directly or through others), copy_id (smallest doc_id with the same set of runs),
    n_links long (other documents linked to it, copies included).

    Null and empty texts, and texts without words, are similar to nothing: class_id and
    copy_id are their own doc_id, n_links is 0. A text with fewer words than a run is one run.
    Repeated rows count as documents. A null doc_id stays null and takes part; ids that are
    minima ignore nulls. An empty table gives no rows.
    """
    return _joined(docs, words, threshold, trees, target_recall, seed).select("doc_id", "class_id", "copy_id", "n_links")


def join_sql(words: int = 5, threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows of ``jaccard_join`` on the table documents: all pairs that share a run are counted."""
    top, below = ratio(threshold)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct([array_to_string(w[i + 1:i + {words}], ' ') FOR i IN range(len(w) - {words - 1})])) END AS runs FROM d),
e AS (SELECT r, len(runs) AS size, unnest(runs) AS run FROM s),
l AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.run = b.run AND a.r <> b.r GROUP BY a.r, b.r, a.size, b.size
      HAVING count(*) * {below + top} >= {top} * (a.size + b.size)),
g AS (SELECT x, y FROM l UNION SELECT r, r FROM s UNION SELECT g.x, l.y FROM g JOIN l ON g.y = l.x),
c AS (SELECT g.x, min(s.doc_id) AS class_id FROM g JOIN s ON g.y = s.r GROUP BY g.x),
m AS (SELECT runs, min(doc_id) AS copy_id FROM s WHERE len(runs) > 0 GROUP BY runs),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT s.doc_id, c.class_id, coalesce(m.copy_id, s.doc_id) AS copy_id, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM s JOIN c ON c.x = s.r LEFT JOIN m ON m.runs = s.runs LEFT JOIN n ON n.x = s.r
"""


#: A word's first character.
HAS_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 32, target_recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row, that with the smallest doc_id.

    Rows are judged by their texts: rows that share a doc_id but not a group are kept apart. In a
    group, null ids come last; among rows of the smallest id the text with the smallest hash
    stays, and among rows that repeat both the one whose columns sort first. Texts without words
    (null and empty ones too) are nobody's duplicates: all their rows stay.
    """
    joined = _joined(docs, words, threshold, trees, target_recall, seed).filter("label is not null")
    first = joined.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tag")).alias("stays")).select("stays.*")
    spoken = F.coalesce(F.col("text").cast("string").rlike(HAS_WORDS), F.lit(False))
    row_id = F.col("doc_id").cast("long")
    keyed = docs.filter(spoken).select(row_id.isNull().alias("none"), F.coalesce(row_id, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = keyed.groupBy("none", "id", "tag").agg(F.min("row").alias("row"))
    return once.join(first, ["none", "id", "tag"], "left_semi").select("row.*").unionByName(docs.filter(~spoken))
