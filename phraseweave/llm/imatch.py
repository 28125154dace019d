"""I-Match fingerprints: terms in a band of inverse document frequency, hashed by randomised lexicon subsets.

The lexicon holds the terms that at least ``least`` and at most ``most`` of all documents have.
There are at most (mean distinct terms of a document) / least of them, whatever the number of
documents; where that is more than ``most_terms``, the band begins at the least frequency from which no
more terms are left. So it is sent to all executors. Each of the lexicon's random subsets gives one hash,
of the sorted distinct terms that a document has in it; subsets of different sizes keep some
hashes equal under small and under large edits.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import U64, WORD_BYTES, Workspace, encode, hash_words, mix, slices, split_words
from phraseweave.llm.language_model import _numbers, _planes

#: Shares of the lexicon that the subsets keep, and how many subsets keep each.
SHARES, OF_EACH = (1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64), 4
SUBSETS = len(SHARES) * OF_EACH
NOTHING = "--------"
#: Terms of a lexicon, at most: with a flag for each subset some 32 bytes each.
MOST_TERMS = 1 << 20


def _count(bits: int):
    """Documents that have each term, of this task: a row for each range of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.zeros(0, U64), np.zeros(0, np.uint32)
        for part in slices(batches):
            at, flat = split_words(part.column("text"), WORD_BYTES)
            codes, words = encode(flat)
            m = max(1, len(words))
            seen = np.unique(np.repeat(np.arange(part.num_rows), np.diff(at)) * m + codes) % m if len(codes) else codes
            all_hashes, which = np.unique(np.concatenate([hashes, hash_words(words)]), return_inverse=True)
            weight = np.concatenate([counts, np.bincount(seen, minlength=len(words))])
            hashes, counts = all_hashes, np.bincount(which, weights=weight, minlength=len(all_hashes)).astype(np.uint32)
            if len(hashes) > 4_000_000:
                yield from _ranges(hashes, counts, bits)
                hashes, counts = hashes[:0], counts[:0]
        yield from _ranges(hashes, counts, bits)

    return run


def _ranges(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    if not len(hashes):
        return
    part = (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cut = np.flatnonzero(np.diff(part)) + 1
    ends = list(zip([0, *cut], [*cut, len(hashes)], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(part[a]) for a, _ in ends], pa.int64()), pa.array([_planes(np.diff(hashes[a:b], prepend=U64(0))) for a, b in ends], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in ends], pa.binary())],
        ["range", "hashes", "counts"],
    )


def _band(low: float, high: float):
    def run(key: tuple, found: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.cumsum(_numbers(x.as_py(), U64), dtype=U64) for x in found.column("hashes")])
        counts = np.concatenate([_numbers(x.as_py(), np.uint32) for x in found.column("counts")])
        distinct, which = np.unique(hashes, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        band = (total >= low) & (total <= high)
        return pa.table({"term": pa.array(distinct[band].view(np.int64)), "n": pa.array(total[band])})

    return run


def lexicon_of(docs: DataFrame, least: float, most: float, rows: int, ranges_bits: int | None = None, most_terms: int = MOST_TERMS) -> np.ndarray:
    """Sorted hashes of the terms that ``least`` to ``most`` of the ``rows`` documents have (two documents at least), the most frequent ones if there are more than ``most_terms``."""
    bits = max(0, math.ceil(math.log2(max(1, rows / 20_000)))) if ranges_bits is None else ranges_bits
    counted = docs.select("text").mapInArrow(_count(bits), "range long, hashes binary, counts binary")
    kept = Workspace(docs.sparkSession, "lexicon").save(counted.groupBy("range").applyInArrow(_band(max(2.0, least * rows), most * rows), "term long, n long"), "band")
    if kept.count() > most_terms:
        # the count of the first term too many, by frequency; terms that are as frequent all stay away
        cut = kept.orderBy(F.desc("n")).limit(most_terms + 1).agg(F.min("n")).first()[0]
        kept = kept.filter(F.col("n") > cut)
    terms = kept.select("term").toArrow()
    return np.sort(terms.column("term").combine_chunks().to_numpy(zero_copy_only=False).view(U64))


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray, seed: int):
        self.lexicon = lexicon
        salts = mix(np.arange(seed + 1, seed + 1 + SUBSETS, dtype=U64) * U64(0x9E3779B97F4A7C15))
        limit = np.repeat(np.array([int(s * 2**64) - 1 for s in SHARES], U64), OF_EACH)
        self.member = mix(lexicon[:, None] ^ salts) <= limit

    def __call__(self, texts: pa.Array) -> list[str]:
        at, flat = split_words(texts, WORD_BYTES)
        codes, words = encode(flat)
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        place = np.full(len(words), -1)
        if len(words) and len(self.lexicon):
            hashes = hash_words(words)
            near = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            place = np.where(self.lexicon[near] == hashes, near, -1)
        term = place[codes] if len(codes) else codes
        wide = max(1, len(self.lexicon))
        pair = np.unique(row[term >= 0] * wide + term[term >= 0])
        rows, terms = pair // wide, pair % wide
        cut = np.searchsorted(rows, np.arange(len(texts) + 1))
        out = []
        for i in range(len(texts)):
            mine = terms[cut[i] : cut[i + 1]]
            if not len(mine):  # nothing in the band: the text's words as they stand
                out.append(xxhash.xxh3_128_hexdigest(b" ".join(w.encode() for w in flat.slice(int(at[i]), int(at[i + 1] - at[i])).to_pylist())))
                continue
            sorted_terms, member = self.lexicon[mine], self.member[mine]
            out.append("".join(xxhash.xxh32_hexdigest(sorted_terms[member[:, j]].tobytes()) if member[:, j].any() else NOTHING for j in range(SUBSETS)))
        return out


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets in which either document has a term; of documents without terms, equality."""
    if len(a) != len(b) or len(a) != 8 * SUBSETS:
        return float(a == b)
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    used = [x == y for x, y in pairs if (x, y) != (NOTHING, NOTHING)]
    return sum(used) / len(used) if used else 1.0


def _print(finger: Fingerprinter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(finger(part.column("text")), pa.string())], ["doc_id", "fingerprint"])

    return run


def fingerprint_documents(docs: DataFrame, least: float = 0.001, most: float = 0.2, seed: int = 11) -> DataFrame:
    """doc_id and I-Match fingerprint of every whole text; equal texts have equal ones.

    A fingerprint is one hash for each lexicon subset, or ``--------`` where the text has no
    term in it; a text without any term of the band is hashed by its words. Null texts are
    empty. Repeated rows and null ids stay; an empty table gives no rows.
    """
    rows = _rows(docs)
    finger = Fingerprinter(lexicon_of(rows, least, most, rows.count()), seed)
    return rows.mapInArrow(_print(finger), "doc_id long, fingerprint string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


@dataclass
class Runs:
    """Runs of rows by descending doc_id, null ids last, then by tie; an id with many rows is split by tie into runs of its own.

    cuts: ids that begin a run, ascending. heavy: of ids with runs of their own, how many; None is the null id.
    """

    cuts: list[int]
    heavy: dict[int | None, int]

    def __post_init__(self) -> None:
        self.first: dict[int, int] = {}
        n = 1
        for i in range(len(self.cuts), -1, -1):  # ids from cut i - 1 on and below cut i
            self.first[i] = n
            n += self.heavy.get(self.cuts[i - 1], 1) if i else 1
        self.nulls = n
        self.count = n + self.heavy.get(None, 1)

    def of(self, doc_id: int | None, tie: int) -> int:
        """The run of a row, from 1. tie: 63 bits. A heavy id is a cut, and so is the id above it."""
        if doc_id is None:
            return self.nulls + (tie * self.heavy.get(None, 1) >> 63)
        i = bisect.bisect_right(self.cuts, doc_id)
        return self.first[i] + (tie * self.heavy.get(doc_id, 1) >> 63)


def runs_of(rows: DataFrame, count: int, rows_a_part: int, most_parts: int) -> Runs:
    """Runs of about ``rows_a_part`` rows, or ``most_parts`` of them."""
    n = max(1, min(most_parts, count // rows_a_part))
    nulls = rows.filter("doc_id is null").count()
    shares = [i / n for i in range(1, n)]
    found = [int(x) for x in rows.approxQuantile("doc_id", shares, 0.2 / n)] if shares else []
    # quantiles that fall on one id more than once show how many runs it fills
    heavy: dict[int | None, int] = {i: k + 1 for i, k in Counter(found).items() if k > 1}
    heavy[None] = max(1, math.ceil(nulls * n / max(1, count)))
    return Runs(sorted({*found, *(i + 1 for i in heavy if i is not None and i < 2**63 - 1)}), heavy)


def _deal(runs: Runs, heads: dict[int, tuple], parts: list[int]):
    """Packed texts dealt into runs; the rows that begin a run go to the run before as well.

    Of rows that a task has more than once one goes there. The others follow an equal row, whatever
    else there is, so they go as one row with their number to any run (look 2).
    """
    before = {p: parts[i - 1] for i, p in enumerate(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[tuple] = set()
        repeated: dict[tuple, list] = {}

        def give(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["part", "look", "doc_id", "tie", "packed", "times"])

        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True):
                key = (doc_id, tie, len(text))
                if key in seen:
                    repeated.setdefault(key, [pack(text.encode()), 0])[1] += 1
                    continue
                seen.add(key)
                part, packed = runs.of(doc_id, tie), pack(text.encode())
                out.append((part, 0, doc_id, tie, packed, 1))
                if heads[part] == (doc_id, tie):
                    out.append((before[part], 1, doc_id, tie, packed, 1))
            if out:
                yield give(out)
        for (doc_id, tie, size), (packed, times) in repeated.items():
            yield give([(parts[(tie + size) % len(parts)], 2, doc_id, tie, packed, times)])

    return run


def _parts(runs: Runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [runs.of(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch.column("doc_id"), batch.column("tie")], ["part", "doc_id", "tie"])

    return run


#: Rows of a batch of equal results.
COPIES = 4096
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDITED_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in EDITED.split(", ")])


def _edit(finger: Fingerprinter, most: int = 4 << 20):
    def close(group: list[tuple[int, str]], after: str | None) -> pa.RecordBatch:
        """Results of all rows but the last, or of all if what comes after it is given."""
        texts = [t for _, t in group] + ([] if after is None else [after])
        n = len(texts) - 1
        edited = [t[: len(t) - len(t) // 3] + texts[i + 1][: len(t) // 3] for i, t in enumerate(texts[:n])]
        prints = finger(pa.array(texts + edited, pa.string()))
        own, new = prints[: n + 1], prints[n + 1 :]
        columns = [
            pa.array([i for i, _ in group[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(own[:n], pa.string()), pa.array(new, pa.string()), pa.array([likeness(own[i], new[i]) for i in range(n)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDITED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        group: list[tuple[int, str]] = []
        part, size, done = None, 0, False
        for batch in batches:
            for p, look, doc_id, packed, times in zip(*(batch.column(c).to_pylist() for c in ("part", "look", "doc_id", "packed", "times")), strict=True):
                if p != part:
                    part, done, group, size = p, False, [], 0
                text = unpack(packed).decode() if look == 2 or not done else ""
                if look == 2:  # rows that equal ones follow
                    (row,) = close([(doc_id, text)], text).to_pylist()
                    for i in range(0, times, COPIES):
                        yield pa.RecordBatch.from_pylist([row] * min(COPIES, times - i), EDITED_SCHEMA)
                    continue
                if done:
                    continue
                if look:  # the first row of the run after this one ends it
                    yield close(group, text)
                    group, done = [], True
                    continue
                group.append((doc_id, text))
                size += len(text)
                if size > most and len(group) > 1:
                    yield close(group, None)
                    group, size = group[-1:], len(text)

    return run


def fingerprint_edits(docs: DataFrame, least: float = 0.001, most: float = 0.2, seed: int = 11, rows_a_part: int = 4096, most_parts: int = 20_000) -> DataFrame:
    """Fingerprints of every whole text and of an edit of it, and how like they are.

    The edit replaces the last floor(n / 3) of n code points by as many first ones (or all) of
    the next document, by descending doc_id (ties: by a hash of the text; null ids last), and
    after the last comes the first. Returns a row for each row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited text's
    fingerprint and to the next document's).

    Texts move once, compressed, into runs of rows that a task reads in order; each run also
    gets the row that begins the next one. An id that many rows have, and null ids, fill several runs,
    dealt by the texts' hash; rows that repeat in a task move once. Null texts are empty; a table of one
    row is its own next; repeated rows follow each other; an empty table gives no rows.
    """
    rows = _rows(docs)
    count = rows.count()
    finger = Fingerprinter(lexicon_of(rows, least, most, count), seed)
    keyed = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    runs = runs_of(rows, count, rows_a_part, most_parts)
    head = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", (-F.col("tie")).alias("less")))
    found = keyed.select("doc_id", "tie").mapInArrow(_parts(runs), "part long, doc_id long, tie long").groupBy("part").agg(head.alias("head")).collect()  # a row for each run
    heads = {r["part"]: (r["head"]["doc_id"], -r["head"]["less"]) for r in found}
    dealt = keyed.mapInArrow(_deal(runs, heads, sorted(heads)), "part long, look int, doc_id long, tie long, packed binary, times long")
    dealt = dealt.repartition(max(1, min(runs.count, most_parts)), "part").sortWithinPartitions("part", "look", F.desc_nulls_last("doc_id"), "tie")
    return dealt.mapInArrow(_edit(finger), EDITED)
