"""The pipeline's stages on small tables, each against a plain version of its decision."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phraseweave.llm.common import Workspace, fold
from phraseweave.llm.quality import grade_quality
from phraseweave.llm.toxicity import score_toxicity
from test_jaccard import brute
from test_packing import one_by_one

SF = "/root/testdata/sf0.01"


def kept_by_class(rows):
    """One row of each class by brute force, all rows without words."""
    classes = {}
    for (i, c, n), (_, text) in zip(sorted(brute(rows)), sorted(rows, key=lambda r: r[0]), strict=True):
        classes.setdefault(c if n or text and text.strip() else ("none", i), set()).add(i)
    return {min(c) for c in classes.values()}


def check_packing(before, packed):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for doc_id, text in before:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, stop, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            pieces[doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start, stop, piece = stop, stop + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024
    assert len(sequences) == len(one_by_one([p[3] for p in pieces.elements()], 1024))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    space = Workspace(spark, "test-pipeline")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    learnt_from = fold(F.col("doc_id"), 5) != 0
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = space.save(stage(spark, docs, SF), f"{i}")
        if name == "best_fit_packing":
            check_packing(before, after.collect())
            break
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "ngram_jaccard_join":
            assert left == kept_by_class(before)
        else:
            column, good = {"quality_classifier": ("quality", 1), "toxicity": ("toxic", 0)}[name]
            plain = grade_quality(docs, labels, learnt_from).filter("keep = 1") if column == "quality" else score_toxicity(docs, labels, learnt_from).filter("predicted = 0")
            assert left == {r.doc_id for r in plain.collect()}
            right = [(d in left, known[d][column] == good) for d, _ in before if d in known]
            assert sum(a == b for a, b in right) >= 0.9 * len(right)
            assert sum(kept for kept, clean in right if clean) >= 0.95 * sum(clean for _, clean in right)
        docs = after


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, tmp_path, name):
    """Null, empty and repeated rows, columns with clashing names, and tables without rows or labels."""
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [(1, "a plain text of some words", 1), (1, "a plain text of some words", 1), (2, None, 2), (2, None, 2), (3, "", 3), (None, "no id here at all", 4), (None, None, 5), (4, long, 6), (5, "!!", 7), (1, "another text with that id", 8)]
    docs = spark.createDataFrame([(i, t, n, "x", 0.5, n, "y", n) for i, t, n in rows], "doc_id long, text string, key long, label string, score double, tag long, row string, nth long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(None, 1, 0), (1, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, docs, str(tmp_path))
    if name == "best_fit_packing":
        check_packing([r[:2] for r in rows], got.collect())
    else:
        assert got.columns == docs.columns
        want = [r[:2] for r in rows]
        if name == "ngram_jaccard_join":
            want.remove((1, "a plain text of some words"))
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
