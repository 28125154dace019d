import hashlib

import pyarrow as pa
import pytest

from phraseweave.llm.common import Workspace
from phraseweave.llm.warc import PROFILE, _walk, archive_digests, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest string, size int"
TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:phraseweave:page:666>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i} é</p>" * (i % 90), None, 1) for i in range(200)]
    big = "same" * 400
    rows += [(300, "u", big, "", 1), (301, None, big, "", 1), (302, "u\r\nX: 1", big, "", 1), (303, "u", "s" * 999, "", 1), (304, "u", "s" * 999, "", 1)]
    rows += [(400, "u", TRAP * 3, "", 1), (401, "u", "WARC/1.1\r\n", "", 1), (402, "u", TRAP + "x" * 2000 + "WARC/1.1\r\nWARC/1.1\r\n", "", 1), (403, "u", "\r\n\r\n" + TRAP, "", 1)]
    # an id that repeats with another payload, each with a later copy
    rows += [(600, "u", "A" * 1200, "", 1), (600, "v", "B" * 1500, "", 1), (601, "u", "A" * 1200, "", 1), (602, "u", "B" * 1500, "", 1), (None, "u", "B" * 1500, "", 1), (None, "u", "C" * 1500, "", 1), (None, "u", "C" * 1500, "", 1)]
    rows += [(700, "u", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\nWARC/1.1\r\nContent-Length: 999999999999999999\r\n\r\n", "", 1)]
    return [*rows, (500, "u", None, "", 1), (501, "u", "", "", 1), (None, "u", "null id", "", 1), (7, "http://x/7", "<p>7 é</p>" * 7, "", 1)]


def brute(rows):
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == data]
        last = max(same, default=None)
        again = len(data) >= 1000 and last is not None and (i is None or i < last)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return out


def key(r):
    return r[0] is None, r[0] or 0, r[1], r[2]


def test_round_trip_in_small_splits(spark):
    rows = pages()
    for split in ("128m", "1k", "333"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = archive_digests(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(brute(rows), key=key), split
        assert all(r.digest_ok is (True if r.record_type == "response" else None) for r in got)


def test_the_splits_of_both_readings_agree_when_executors_come_and_go(spark, monkeypatch):
    rows, cores = pages(), iter([4, 3, 7, 2] * 50)
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda *a: (spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores)), save(*a))[1])
    try:
        got = archive_digests(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(brute(rows), key=key)


def test_a_split_that_moved_is_an_error():
    names = ["file", "stretch", "stretches", "total", "base", "entry", "until", "value"]
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in ("f", 0, 2, 40, 0, 0, None, b"x")], names)
    with pytest.raises(ValueError, match="other bounds"):
        list(_walk(False)(iter([batch])))


def test_records_of_other_writers(spark, tmp_path):
    records = [b"WARC/1.1\r\nwarc-type: resource\r\nContent-Length: 3\r\n\r\n\xff\xfe\x00\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\ncontent-length:  20\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join(records) + b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 900\r\n\r\ncut")
    (tmp_path / "b.warc").write_bytes(b"not WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    for split in ("128m", "30"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {(r.type, bytes(r.payload)) for r in read_warc(str(tmp_path), Workspace(spark, "other")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {("resource", b"\xff\xfe\x00"), ("response", b"WARC/1.1\r\nWARC/1.1\r\n"), ("metadata", b"cut")}, split


def test_a_revisit_says_how_it_was_found_equal(spark):
    space = Workspace(spark, "test")
    write_warc(spark.createDataFrame(pages(), SCHEMA), f"{space.path}/w", space)
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(f"{space.path}/w").collect())
    assert text.count("WARC-Type: revisit") == text.count(f"WARC-Profile: {PROFILE}") == sum(b[3] == "revisit" for b in brute(pages()))


def test_payloads_come_back(spark):
    rows = pages()
    space = Workspace(spark, "test")
    write_warc(spark.createDataFrame(rows, SCHEMA), f"{space.path}/w", space, dedup_bytes=10**9)
    got = read_warc(f"{space.path}/w", space)
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted((r[2] or "").encode() for r in rows)


def test_empty_table(spark):
    assert archive_digests(spark.createDataFrame([], SCHEMA)).collect() == []
