import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from phraseweave.llm.imatch import NOTHING, OF_EACH, SHARES, Runs, fingerprint_documents, fingerprint_edits, lexicon_of, likeness

SCHEMA = "doc_id long, text string, fingerprint int, part string"
M64 = 2**64 - 1


def corpus():
    rng = random.Random(6)
    vocab = [f"t{int(rng.paretovariate(0.7)) % 3000}é" for _ in range(4000)]
    rows = [(i * 3, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 40, 400])))) for i in range(160)]
    return [*rows, (9, rows[3][1]), (9, rows[3][1]), (None, "null id words"), (None, None), (5000, ""), (5001, "🙂" * 7), (701, "only twice"), (703, "only twice"), (-4, "below zero")]


def crowded():
    """One id with very many texts, very many rows without any, and rows that repeat."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(12)))
    rows = [(50, text()) for _ in range(150)] + [(None, text()) for _ in range(120)] + [(i, text()) for i in range(100)]
    return rows + [(70, "the same again")] * 90 + [(None, "and this")] * 40 + [(50, "a a a")] * 30


def brute(spark, rows):
    """(doc_id, n_chars, sha of the edit) of each row, in the order of the operator."""
    ties = {r.t: r.h % 2**64 >> 1 for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is None, -(i or 0), ties[t or ""], i, t or "") for i, t in rows), key=lambda x: x[:3])
    out = []
    for (*_, i, text), (*_, after) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(text) // 3
        out.append((i, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("rows_a_part", [10_000, 7])
@pytest.mark.parametrize("rows", [corpus(), crowded()], ids=["corpus", "crowded"])
def test_edits(spark, rows, rows_a_part):
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3)
    got = fingerprint_edits(docs, least=0.02, rows_a_part=rows_a_part).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(spark, rows)
    prints = Counter((r.doc_id, r.fingerprint) for r in got)
    assert Counter((r.doc_id, r.fingerprint) for r in fingerprint_documents(docs, least=0.02).collect()) == prints
    assert all(r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) for r in got)
    single = {i for i, n in Counter(i for i, _ in rows).items() if i is not None and n == 1}
    own = {r.doc_id: r.fingerprint for r in got}
    order = sorted(own.keys() - {None}, reverse=True)
    nexts = dict(zip(order, order[1:], strict=False))
    for r in got:
        if r.doc_id in single and nexts.get(r.doc_id) in single:
            assert r.near_next == likeness(r.fingerprint, own[nexts[r.doc_id]])
    long = [r for r in got if r.n_chars > 1000]
    if long:
        assert own[701] == own[703]
        assert sum(r.near_edited for r in long) > sum(r.near_next for r in long) + 0.1 * len(long)


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def test_fingerprints_against_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus())]
    sets = {i: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for i, t in rows}
    seen = Counter(w for s in sets.values() for w in s)
    band = {w for w, n in seen.items() if max(2, 0.02 * len(rows)) <= n <= 0.2 * len(rows)}
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in band}
    got = {r.doc_id: r.fingerprint for r in fingerprint_documents(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(4), least=0.02, seed=11).collect()}
    some = 0
    for i, text in rows:
        mine = sorted(hashes[w] for w in sets[i] & band)
        if not mine:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
            assert got[i] == xxhash.xxh3_128_hexdigest(" ".join(words))
            continue
        want = ""
        for j, share in enumerate(s for s in SHARES for _ in range(OF_EACH)):
            salt = mixed((11 + 1 + j) * 0x9E3779B97F4A7C15 & M64)
            chosen = [h for h in mine if mixed(h ^ salt) <= int(share * 2**64) - 1]
            want += xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in chosen)) if chosen else NOTHING
        some += 1
        assert got[i] == want
    assert some > 60


def test_a_large_lexicon_keeps_its_most_frequent_terms(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(30) if i % (k + 1) == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = lexicon_of(docs, 0.0, 1.0, 120)
    assert len(every) == 30 and set(lexicon_of(docs, 0.0, 1.0, 120, most_terms=30)) == set(every)
    few = lexicon_of(docs, 0.0, 1.0, 120, most_terms=9)
    assert set(few) == {xxhash.xxh3_64_intdigest(f"w{k}") for k in range(9)}


def test_runs_of_heavy_ids():
    runs = Runs([3, 4, 10], {3: 4, None: 3})
    ties = [0, 1 << 61, 1 << 62, 3 << 61, (1 << 63) - 1]
    rows = [(12, 5), (10, 9), (9, 1), (4, 2), *((3, t) for t in ties), (2, 7), (-5, 0), *((None, t) for t in ties)]
    got = [runs.of(*r) for r in rows]
    assert got == sorted(got) and len(set(got[4:9])) == 4 and len(set(got[11:])) == 3 and got[-1] < runs.count


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0, "")], SCHEMA)
    (r,) = fingerprint_edits(docs).collect()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"a b c d a b").hexdigest())
    assert fingerprint_edits(docs.limit(0)).collect() == []
