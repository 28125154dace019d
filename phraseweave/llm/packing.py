"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so bins with the same room left are alike. The
driver gets one count for each length (as many as the capacity, however large the corpus),
plans best-fit decreasing for all pieces of a length at once, and writes down runs: pieces
ranked r to r' of a length go to bins b, b + 1, ... at a fixed offset. Ranks within a length are
dealt by salted counts, so a length that most pieces share doesn't gather in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseweave.llm.common import Workspace, slices

#: Texts are taken apart before runs of spaces and line feeds that follow anything else. The vocabulary's pattern
#: never joins two such parts, unless other white space stands in the text.
PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
RUN = re.compile(r"[ \n]{2}")
#: Stands before each part of a text without such runs.
MARK = "\0"
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: How the vocabulary's library splits texts before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the characters that a byte-level vocabulary is written in: printable ones stand for themselves, the others for 256 on.
PRINTABLE = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Parts whose ids a worker remembers; it forgets all when there are more.
REMEMBERED = 250_000


class PartTokens(dict):
    """Ids (little-endian unsigned 32-bit) of parts of texts, as the tokenizers library encodes them."""

    loaded: dict[str, PartTokens] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # ids of merge-type vocabularies rank their merges, so the same ids come from the ranks alone, with less work a call
        plain = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in plain.items()}
        self.short = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> PartTokens:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        if RUN.search(text) or MARK in text:
            return PARTS.findall(text)
        parts = text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)
        return parts if parts[0] else parts[1:]

    def encode(self, text: str) -> bytes:
        if OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, self.parts(text)))

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = np.array(self.short(part), "<u4").tobytes()
        return ids


PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [*PIECE, ("ids", pa.binary())] if with_ids else PIECE
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PartTokens.of(path)
        for part in slices(batches):
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = tokens.encode(text) + end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    mine = ids[4 * start : 4 * stop]
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(mine), mine), strict=False):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], [name for name, _ in fields])

    return run


class CapacityTree:
    """A segment tree over capacities 0 to n: how many open bins have each, and the least one of at least a size."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: go up until there is a right sibling
                i >>= 1
                if not i:
                    return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, pieces in each bin, offset of the first) of best-fit decreasing.

    The pieces of a length fill the tightest open bin until it can't take another, as they
    would one by one, then the next tightest; without an open bin they open new ones.
    """
    tree = CapacityTree(capacity)
    room: dict[int, list[tuple[int, int]]] = {}
    bins = 0
    runs = []

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            room.setdefault(left, []).append((first, count))
            tree.add(left, count)

    for length in sorted(lengths, reverse=True):
        rank, n = 0, lengths[length]
        while n:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                each = left // length
                first, count = bins, -(-n // each)
                bins += count
            else:
                each = left // length
                first, count = room[left].pop()
                tree.add(left, -count)
                need = -(-n // each)
                if need < count:
                    put(left, first + need, count - need)
                    count = need
            placed = min(n, count * each)
            runs.append((length, rank, placed, first, each, capacity - left))
            full, rest = divmod(placed, each)
            put(left - each * length, first, full)
            if rest:
                put(left - rest * length, first + full, 1)
            rank, n = rank + placed, n - placed
    return runs


def _place(runs: list[tuple]):
    table = np.array(runs, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    starts = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = table[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 3] + nth // np.maximum(at[:, 4], 1), at[:, 5] + nth % np.maximum(at[:, 4], 1) * length
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int, space: Workspace, rows_a_salt: int = 200_000) -> DataFrame:
    """sequence_id and offset for stored ``pieces`` (doc_id, piece, start, length, ids_crc32, and ids or not) of length 1 to capacity."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    salts = max(8, sum(counts.values()) // rows_a_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(first.select("length", "salt", "first"), ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("first") + F.col("nth") - 1).alias("rank"))
    ids = ", ids binary" if "ids" in pieces.columns else ""
    return ranked.mapInArrow(_place(best_fit_decreasing(counts, capacity)), f"{PIECES}{ids}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """All documents as token sequences of at most ``capacity`` tokens, few of them.

    Takes doc_id and text. A document is its ids by the tokenizer file ``tokenizer`` without
    special tokens, then ``end_id``. A longer one than the capacity is cut into full pieces
    behind a first one that may be shorter. Returns a row for each piece: doc_id, piece (from
    0), start (the document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), sequence_id (from 0, gapless), offset (its place there; each
    sequence is filled from 0 without gaps).

    Null and empty texts are the end id alone. Repeated rows are packed each, null ids stay
    null, and an empty table gives no rows.
    """
    return _packed(docs, tokenizer, capacity, end_id, with_ids=False)


def _packed(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    space = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else ""))
    return pack_pieces(space.save(pieces, "pieces"), capacity, space)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The sequences of ``pack_documents`` themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit), pieces.

    pieces has doc_id, piece and offset of what a sequence holds, in order. A sequence is a row of at most
    ``capacity`` tokens, so what is gathered for it is bounded. Nulls and ties as there; an empty table gives no rows.
    """
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = _packed(docs, tokenizer, capacity, end_id, with_ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    pieces = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset")))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"), ids.alias("ids"), pieces.alias("pieces"))
