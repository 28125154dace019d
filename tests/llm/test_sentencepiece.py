import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from phraseweave.llm.sentencepiece_codec import BacktrackingEncoder, digest_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, ids string"


def texts(n):
    rng = random.Random(n)
    parts = ["the", "er", "ing", " ", "  ", "\n", "▁", "é", "ñ", "漢", "🙂", "<s>", "<0x0A>", "\x00", "q", "zz", "tion", "Ⅳ", "1999"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_are_the_library_s():
    codec = BacktrackingEncoder.of(PATH)
    for text in [*texts(1500), "", " ", "a" * 300, "the " * 200]:
        ids = LIBRARY.encode(text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        assert codec.decode(np.array([1, *ids, 2])) == LIBRARY.decode([1, *ids, 2])


def test_decoding_of_any_ids():
    codec, rng = BacktrackingEncoder.of(PATH), random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32000), 0, 29871]) for _ in range(rng.randrange(9))]
        assert codec.decode(np.array(ids, int)) == LIBRARY.decode(ids), ids


def test_rows(spark):
    rows = [*enumerate(texts(60)), (5, "again"), (5, "again"), (None, "x"), (77, None), (78, "")]
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids).encode())))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in digest_documents(docs, PATH).collect()), key=key) == sorted(want, key=key)
    assert {(r.doc_id, r.decoded) for r in encode_documents(docs, PATH).collect() if r.doc_id == 5} >= {(5, "again")}
    assert digest_documents(docs.limit(0), PATH).collect() == []
