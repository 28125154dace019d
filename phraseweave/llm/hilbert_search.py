"""Nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few dimensions by random orthonormal bases, spread evenly in each,
shifted, and put on a Hilbert curve, once for each curve. Spark sorts a curve by range, which
gives every vector its rank there. A query looks at the window of ranks around its own on
every curve; the windows' best are merged by the exact cosine of the original vectors.

Sorting moves keys only. Ranks are cut into tiles; each vector goes to its tile of a curve once,
and vectors that ask go to the tiles that their window reaches as well. A task holds one tile
and streams the askers past it, so its memory doesn't depend on how many there are.

Width and number of curves are measured: a bounded sample of queries is searched by brute force, and
the half width is the least at which the windows hold the wanted share of true neighbours. Curves
are doubled until the windows together hold at most ``share`` of all vectors; where no
number up to ``most_curves`` does, the one with the smallest windows in sum is taken. So recall
holds at any size, and vectors without structure that few dimensions keep cost wide windows.

Vectors of one direction are one point with its smallest ids, so a vector that very many rows
share neither fills windows nor gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseweave.llm.common import Workspace

#: Ranks of a curve in a tile.
TILE = 2048
#: Askers that are scored at once, and pairs of vectors whose exact cosines are.
ASKERS, PAIRS = 256, 65_536
#: Repeated vectors whose ids a task holds back to send them once.
HELD = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places on the Hilbert curve of cells (n x d whole numbers of ``bits`` bits), as words of whole levels, coarsest first.

    The curve is walked from the coarsest bit to the finest: each level's orthant is read in
    Gray-code order in the frame of the levels above, and every orthant turns the frame
    (swaps two axes and mirrors) so that it begins where the one before it ends.
    """
    x = np.ascontiguousarray(cells.astype(np.int64).T)
    d, n = x.shape
    for level in range(bits - 1, -1, -1):
        low = (1 << level) - 1
        for axis in range(d):
            high = -(x[axis] >> level & 1)
            x[0] ^= high & low
            swap = ~high & (x[0] ^ x[axis]) & low
            x[0] ^= swap
            x[axis] ^= swap
    words, key, mirrored = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        gray = np.zeros(n, np.int64)
        for axis in range(d):
            gray = gray << 1 | (x[axis] >> level & 1)
        shift = 1
        while shift < d:  # the rank of a Gray code
            gray ^= gray >> shift
            shift *= 2
        # after an odd rank the ranks of all finer levels run in the mirrored order
        key = key << d | (gray ^ mirrored)
        mirrored ^= -(gray & 1) & ((1 << d) - 1)
        if not level or (bits - level) % (63 // d) == 0:
            words.append(key)
            key = np.zeros(n, np.int64)
    return words


class Curves:
    """Projections and shifts of the curves; each dimension is spread evenly by the quantiles of a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, self.dims = bits, min(dims, width)
        self.bases = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = [rng.random(self.dims) * 0.5 for _ in range(curves)]
        self.shares = np.linspace(0, 1, 65)
        self.quantiles = [np.quantile(sample @ b, self.shares, axis=0) for b in self.bases]

    def keys(self, units: np.ndarray, curve: int) -> list[np.ndarray]:
        """Two words for each vector."""
        at = units @ self.bases[curve]
        even = np.stack([np.interp(at[:, j], self.quantiles[curve][:, j], self.shares) for j in range(self.dims)], axis=1)
        cells = (even * 0.5 + self.shifts[curve]) * ((1 << self.bits) - 1)
        words = hilbert_keys(cells.astype(np.int64), self.bits)
        return [words[0], words[1] if len(words) > 1 else np.zeros(len(units), np.int64)]


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def direction(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, in double precision: equal for parallel ones, and no square overflows."""
    vectors = vectors.astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that of b (directions), in double precision; the same numbers always give the same result."""
    lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.clip((a * b).sum(axis=1) / lengths, -1.0, 1.0)


def _units(directions: np.ndarray) -> np.ndarray:
    return directions / np.sqrt((directions * directions).sum(axis=1, keepdims=True))


def _rows(kind: type, width: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    column = batch.column("vector")
    flat = column.values.slice(column.offsets[0].as_py(), batch.num_rows * width).to_numpy(zero_copy_only=False)
    vectors = flat.astype(kind).reshape(-1, width) + kind(0)  # no negative zeros
    along = direction(vectors)
    return vectors, along, [xxhash.xxh3_128_digest(row.tobytes()) for row in along]


def _points(kind: type, width: int, every: int, keep: int):
    """Of this task: each direction with a vector of it, its ``keep`` smallest ids, whether it asks, and its cosine with itself."""
    names = ["digest", "vector", "ids", "asks", "itself"]
    types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.float64()]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, along, digests = _rows(kind, width, batch)
            itself = cosines(along, along)
            places: dict[bytes, list[int]] = {}
            for i, digest in enumerate(digests):
                places.setdefault(digest, []).append(i)
            vec_ids, once = batch.column("vec_id").to_pylist(), []
            for digest, at in places.items():
                ids = sorted({vec_ids[i] for i in at})
                row = (digest, min(vectors[i].tobytes() for i in at), ids[:keep], any(v % every == 0 for v in ids), itself[at[0]])
                if digest in held:
                    _, vector, before, asks, _ = held[digest]
                    held[digest] = (digest, min(vector, row[1]), sorted({*before, *row[2]})[:keep], asks or row[3], row[4])
                elif len(at) > 1 and len(held) < HELD:
                    held[digest] = row
                else:
                    once.append(row)
            if once:
                yield give(once)
        if held:
            yield give(list(held.values()))

    return run


def _queries(kind: type, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_rows(kind, width, batch)[2], pa.binary())], ["query_id", "digest"])

    return run


def _place(curves: Curves, which: range, kind: type, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(direction(_matrix(batch.column("vector"), kind, width)))
            for c in which:
                high, low = curves.keys(units, c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), c), pa.int32()), pa.array(high), pa.array(low), batch.column("point")], ["curve", "high", "low", "point"])

    return run


def best_pairs(scores: np.ndarray, askers: np.ndarray, others: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best by exact cosine, ties to the smaller least id, and those cosines.

    ``scores`` are cosines in single precision, -inf where a pair doesn't count. What may reach a
    row's k-th best within their error is computed exactly from the directions.
    """
    kth = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
    row, column = np.nonzero((scores >= kth[:, None] - 2e-6 * np.sqrt(askers.shape[1])) & (scores > -np.inf))
    exact = np.concatenate([cosines(askers[row[i : i + PAIRS]], others[column[i : i + PAIRS]]) for i in range(0, max(1, len(row)), PAIRS)])
    order = np.lexsort((least[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k], exact[nth < k]


FOUND = pa.list_(pa.struct([("neg", pa.float64()), ("least", pa.int64()), ("point", pa.int64())]))


def _search(kind: type, width: int, half: int, k: int):
    """Askers against the part of a tile that their windows reach; rows come by tile, a tile's members before its askers."""
    columns = ["rank", "point", "least", "vector"]

    class Held:
        """A tile's members."""

        def __init__(self, batches: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
            self.rank, self.point, self.least = (rows.column(c).to_numpy() for c in columns[:3])
            self.along = direction(_matrix(rows.column("vector"), kind, width))
            self.units = _units(self.along).astype(np.float32)

        def search(self, rows: pa.RecordBatch) -> pa.RecordBatch:
            rank, point = rows.column("rank").to_numpy(), rows.column("point").to_numpy()
            along = direction(_matrix(rows.column("vector"), kind, width))
            scores = _units(along).astype(np.float32) @ self.units.T
            out_of_reach = np.abs(self.rank[None, :] - rank[:, None]) > half
            scores[out_of_reach | (self.point[None, :] == point[:, None])] = -np.inf
            row, column, exact = best_pairs(scores, along, self.along, self.least, k)
            pairs = pa.StructArray.from_arrays([pa.array(0.0 - exact), pa.array(self.least[column]), pa.array(self.point[column])], fields=list(FOUND.value_type))
            asked = np.unique(row)
            offsets = np.append(np.searchsorted(row, asked), len(row)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(point[asked]), pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(FOUND)], ["asker", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members, held = None, [], None
        for batch in batches:
            curve, place, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "tile", "asks"))
            cut = np.flatnonzero((np.diff(curve) != 0) | (np.diff(place) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cut] if batch.num_rows else [], [*cut, batch.num_rows], strict=bool(batch.num_rows)):
                if (curve[a], place[a]) != tile:
                    tile, members, held = (curve[a], place[a]), [], None
                rows = batch.slice(int(a), int(b - a)).select(columns)
                if not asks[a]:
                    members.append(rows)
                    continue
                held = held or Held(members)
                members = []
                for i in range(0, rows.num_rows, ASKERS):
                    yield held.search(rows.slice(i, ASKERS))

    return run


def _truth(queries: np.ndarray, own: np.ndarray, kind: type, width: int, k: int):
    """The sample's best of all vectors of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, point = np.full((len(queries), 0), 0.0), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column("point").to_numpy()
            new = queries @ _units(direction(_matrix(batch.column("vector"), kind, width))).T
            new[own[:, None] == here[None, :]] = -np.inf
            score, point = np.concatenate([score, new], axis=1), np.concatenate([point, np.broadcast_to(here, new.shape)], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, point = np.take_along_axis(score, best, 1), np.take_along_axis(point, best, 1)
        query = np.repeat(np.arange(len(queries)), score.shape[1])
        there = score.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(query[there]), pa.array(point.ravel()[there]), pa.array(score.ravel()[there])], ["query", "point", "near"])

    return run


def sorted_ranks(points: DataFrame, model: Curves, which: range, kind: type, width: int, space: Workspace) -> DataFrame:
    """(curve, point, rank) of every point on the curves ``which``."""
    placed = points.select("point", "vector").mapInArrow(_place(model, which, kind, width), "curve int, high long, low long, point long")
    order = ["curve", "high", "low", "point"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "point", F.monotonically_increasing_id().alias("place"))
    placed = space.save(placed, f"placed-{which.start}").withColumn("part", F.shiftright("place", 33))
    upto = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("curve", "part").agg(F.min("place").alias("begin"), F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    starts = space.save(starts.drop("n"), f"starts-{which.start}")
    # a row for each task of the sort and a few where a curve begins, whatever the number of points
    return placed.join(F.broadcast(starts), ["curve", "part"]).select("curve", "point", (F.col("first") + F.col("place") - F.col("begin")).alias("rank"))


def measured_curves(points: DataFrame, count: int, model: Curves, kind: type, width: int, k: int, most_curves: int, sample: int, recall: float, share: float, space: Workspace) -> tuple[DataFrame, int]:
    """Ranks on as many curves as are needed, and half the window at which they hold the share ``recall`` of the sample's true neighbours."""
    chosen = points.filter("asks").orderBy("digest").limit(sample).select("point", "vector").toArrow().combine_chunks()
    own = chosen.column("point").to_numpy()
    queries = _units(direction(_matrix(chosen.column("vector").combine_chunks(), kind, width)))
    truth = points.select("point", "vector").mapInArrow(_truth(queries, own, kind, width, k), "query long, point long, near double")
    order = Window.partitionBy("query").orderBy(F.desc("near"), "point")
    truth = truth.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query", "point").collect()  # k rows for each of the sample
    wanted = sorted({*own.tolist(), *(r["point"] for r in truth)})
    wanted = points.sparkSession.createDataFrame([(p,) for p in wanted], "point long")
    ranks: DataFrame | None = None
    at: dict[tuple[int, int], int] = {}
    tried: list[tuple[int, int, int]] = []
    curves = 0
    while curves < most_curves:
        which = range(curves, min(most_curves, max(4, 2 * curves)))
        more = sorted_ranks(points, model, which, kind, width, space)
        at |= {(r["curve"], r["point"]): r["rank"] for r in more.join(F.broadcast(wanted), "point").collect()}
        ranks = more if ranks is None else ranks.union(more)
        curves = which.stop
        apart = np.sort([min(abs(at[c, r["point"]] - at[c, own[r["query"]]]) for c in range(curves)) for r in truth])
        half = int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if truth else 0
        tried.append((curves * min(count, 2 * half + 1), curves, half))
        if tried[-1][0] <= share * count:
            break
    _, curves, half = min(tried)
    # so wide that a window has k others on every curve, if there are so many
    return ranks.filter(F.col("curve") < curves), max(half, k)


def nearest_neighbours(
    vectors: DataFrame, every: int = 50, k: int = 5, most_curves: int = 32, dims: int = 8, bits: int = 14, recall: float = 0.94, share: float = 0.25, sample: int = 200, fit_rows: int = 2000, seed: int = 3
) -> DataFrame:
    """The k nearest rows by cosine of every row whose vec_id is divisible by ``every``.

    Takes vec_id and embedding (an array of numbers). Returns query_id, rank (from 1), vec_id,
    score: nearest first, ties to the smaller vec_id; all candidates where there are fewer than
    k. The curves are fit on at most ``fit_rows`` vectors, their number and window on at most
    ``sample`` queries (both chosen by a hash of the direction), for the wanted ``recall``.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor
    do rows without id and vectors of another length than most have. Repeated rows are one
    row; an id with several vectors is found by each of them and asks with each; an empty table
    gives no rows.
    """
    space = Workspace(vectors.sparkSession, "hilbert")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter("forall(vector, x -> x is not null and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    result = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], result)
    width = widths["width"]
    rows = rows.filter(F.size("vector") == width)
    keep = k + 1
    partial = rows.mapInArrow(_points(kind, width, every, keep), "digest binary, vector binary, ids array<long>, asks boolean, itself double")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    points = partial.groupBy("digest").agg(F.min("vector").alias("vector"), smallest.alias("ids"), F.max("asks").alias("asks"), F.max("itself").alias("itself"))
    points = space.save(points.withColumn("point", F.monotonically_increasing_id()), "points")
    count = points.count()
    if not points.filter("asks").limit(1).count():
        return vectors.sparkSession.createDataFrame([], result)
    fit = points.orderBy("digest").limit(fit_rows).select("vector").toArrow()
    model = Curves(_units(direction(_matrix(fit.column("vector").combine_chunks(), kind, width))), most_curves, dims, bits, seed)
    ranks, half = measured_curves(points, count, model, kind, width, k, most_curves, sample, recall, share, space)

    members = ranks.join(points.select("point", "asks", F.col("ids")[0].alias("least"), "vector"), "point")
    tile = lambda rank: F.floor(rank / TILE).cast("long")
    home = F.struct(tile(F.col("rank")).alias("tile"), F.lit(False).alias("asks"))
    reached = F.sequence(tile(F.greatest(F.lit(0), F.col("rank") - half)), tile(F.least(F.lit(count - 1), F.col("rank") + half)))
    asking = F.transform(reached, lambda t: F.struct(t.alias("tile"), F.lit(True).alias("asks")))
    dealt = members.select("curve", "rank", "point", "least", "vector", F.explode(F.when(F.col("asks"), F.concat(F.array(home), asking)).otherwise(F.array(home))).alias("to"))
    dealt = dealt.select("curve", "to.tile", "to.asks", "rank", "point", "least", "vector").repartition("curve", "tile").sortWithinPartitions("curve", "tile", "asks", "rank")
    found = dealt.mapInArrow(_search(kind, width, half, k), "asker long, found array<struct<neg: double, least: long, point: long>>")
    best = found.groupBy("asker").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found"))
    best = best.select("asker", F.explode("found").alias("f")).select("asker", "f.neg", "f.point").join(points.select("point", "ids"), "point")
    others = best.groupBy(F.col("asker").alias("point")).agg(F.collect_list(F.struct("neg", "ids")).alias("others"))
    pairs = F.expr("concat(transform(ids, i -> struct(0.0D - itself as neg, i as vec_id)), flatten(transform(coalesce(others, array()), o -> transform(o.ids, i -> struct(o.neg as neg, i as vec_id)))))")
    asked = points.filter("asks").join(others, "point", "left").select("digest", F.array_sort(pairs).alias("pairs"))
    queries = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_queries(kind, width), "query_id long, digest binary").distinct()
    near = queries.join(asked, "digest").select("query_id", F.posexplode(F.slice(F.filter("pairs", lambda p: p["vec_id"] != F.col("query_id")), 1, k)).alias("nth", "p"))
    return near.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("p.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("p.neg")).alias("score"))
