import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phraseweave.llm.packing import CapacityTree, best_fit_decreasing, pack_documents, packed_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, rank int"


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            b = min(fits, key=lambda b: bins[b])
            bins[b] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def placed(counts, capacity):
    bins = {}
    for length, rank, n, first, each, offset in best_fit_decreasing(counts, capacity):
        for k in range(n):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 1024])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randrange(400))]
    counts = {n: lengths.count(n) for n in lengths}
    bins = placed(counts, capacity)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == one_by_one(lengths, capacity)


def test_tree_finds_the_tightest():
    rng = random.Random(0)
    tree, have = CapacityTree(1024), {}
    for _ in range(500):
        c = rng.randint(0, 1024)
        tree.add(c, 1)
        have[c] = 1
        n = rng.randint(0, 1024)
        assert tree.tightest(n) == min((x for x in have if x >= n), default=None)


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "erble\n", "Ünder ", "été,", "\t", "x" * 9, "don't", "  "]) for _ in range(rng.choice([0, 3, 50, 900]))), None, 1) for i in range(80)]
    rows += [(90, None, "", None), (91, "", "", 1), (3, rows[3][1], "", 1), (None, " \n  a\n\n", "", 1), (92, "a <|endoftext|>", "", 1)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 1024
    assert sorted(sequences) == list(range(len(one_by_one([r.length for r in got], 1024))))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_sequences_hold_the_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["tree", "Größe", "x1", "\n", "of the"]) for _ in range(rng.choice([0, 3, 200, 2500])))) for i in range(40)] + [(None, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    sequences = packed_sequences(docs, PATH, capacity=512).collect()
    assert sorted(s.sequence_id for s in sequences) == list(range(len(sequences)))
    found = []
    for s in sequences:
        ids = np.frombuffer(bytes(s.ids), "<u4").tolist()
        assert len(ids) == s.n_tokens <= 512 and s.pieces[0].offset == 0
        ends = [p.offset for p in s.pieces[1:]] + [len(ids)]
        found += [(p.doc_id, p.piece, ids[p.offset : end]) for p, end in zip(s.pieces, ends, strict=True)]
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 512 + 1, len(ids) + 1, 512)]
        want += [(doc_id, n, ids[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert packed_sequences(docs.limit(0), PATH).collect() == []
