"""WARC archives: writing with payload deduplication, and splittable reading with boundary-chain verification.

Reading deals any stretch of a file to any task: the text source cuts a split at the record
magic, inside payloads too, and every stretch that begins with the magic is a candidate. A candidate
whose header parses emits the offset of its successor (header and content length say where it
is). From offset 0 of each file, pointer jumping keeps the candidates that the chain of
successors reaches; magic inside payloads is never reached. Runs in which each successor is
the next candidate of the same split are contracted to one node before, so a clean file has a
node for each split.

What the chain says about a split is where its first record begins and where the record ends that
comes in from before. With these two numbers a second reading walks the split's records in order;
payloads don't move between tasks, but for the pieces of records that cross the end of a split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseweave.llm.common import Workspace, slices

MAGIC, LINE = "WARC/1.1\r\n", "\r\n"
#: What a revisit says about how it was found equal. Fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A length that 64 bits hold, also after a header's is added.
DIGITS = "([0-9]{1,18})(?![0-9])"
#: Parts that the rows of one payload are dealt into when they learn whom they revisit.
SALTS = 16


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed, with their size and digest."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches, "payload"):
        payloads = [p.encode() for p in batch.column("payload").to_pylist()]
        made = [pa.array([hashlib.sha1(p).digest() for p in payloads], pa.binary()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([pack(p) for p in payloads], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "digest", "size", "packed"])


def _records(date: str):
    uri = "<urn:phraseweave:page:{}>".format

    def record(page_id: int | None, url: str | None, digest: bytes, size: int, packed: bytes, refers_to: int | None, unpack) -> str:
        again = refers_to is not None
        payload = "" if again else unpack(packed).decode()
        named = uri("none" if page_id is None else page_id)
        lines = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {named}", f"WARC-Date: {date}", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""), f"WARC-Payload-Digest: sha1:{digest.hex()}", f"X-Payload-Length: {size}"]
        lines += [f"WARC-Refers-To: {uri(refers_to)}", f"WARC-Profile: {PROFILE}"] if again else []
        lines += ["Content-Type: text/html", f"Content-Length: {0 if again else size}"]
        return MAGIC + LINE.join(lines) + LINE + LINE + payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        columns = ["page_id", "url", "digest", "size", "packed", "refers_to"]
        for batch in slices(batches, "packed", 2 << 20):
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record(*row, unpack) for row in rows], pa.string())], ["value"])

    return run


def write_warc(pages: DataFrame, path: str, space: Workspace, dedup_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row of ``pages`` (page_id, url, html) in files below ``path``.

    The payload is the html in UTF-8, null: empty. Among records with equal payloads of at least
    ``dedup_bytes`` bytes, those with the largest page_id are responses (rows that repeat it too), the
    others are revisits of it without payload; a null page_id is less than any, and where it is
    the only one its records are responses. Digests find equal payloads, each row learns whom
    it revisits by a join on the digest, and payloads are shuffled once, compressed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    keyed = rows.select("page_id", F.unhex(F.sha1(F.col("payload").cast("binary"))).alias("digest"), F.octet_length("payload").cast("long").alias("size")).filter(F.col("size") >= dedup_bytes)
    best = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1 and largest is not null").drop("n")
    best = space.save(best, "best").select("digest", "size", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    packed = rows.mapInArrow(_pack, "page_id long, url string, digest binary, size long, packed binary").withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS)))
    joined = packed.join(best.hint("merge"), ["digest", "size", "salt"], "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest")).alias("refers_to")
    made = joined.select("page_id", "url", "digest", "size", "packed", refers_to).mapInArrow(_records(date), "value string")
    made.write.mode("overwrite").option("lineSep", LINE + LINE).text(path)


@contextmanager
def pinned_splits(spark: SparkSession):
    """Files are cut into the same splits by all plans made within, whatever executors come and go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def candidates(files: DataFrame) -> DataFrame:
    """Stretches of files from magic to magic: their order in a split, their bytes, and how long a record their header says."""
    magic = len(MAGIC)
    parts = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("body"))
    ends = F.instr(F.col("body").cast("string"), "\r\n\r\n")
    parts = parts.withColumn("head", F.when(ends > 0, F.substring_index(F.col("body").cast("string"), "\r\n\r\n", 1)))
    length = F.expr(rf"try_cast(regexp_extract(head, '(?i)(?:^|\n)Content-Length: *{DIGITS}', 1) AS BIGINT)")
    return parts.withColumns({"size": F.octet_length("body").cast("long") + magic, "record": F.octet_length("head") + magic + 4 + length + 4})


def chained_splits(found: DataFrame, space: Workspace) -> DataFrame:
    """What the chain from each file's start says about each split of ``found`` (file, stretch, place, size, record).

    Returns file, stretch, stretches and total (of candidates and of bytes), base (offset of the first
    candidate), entry (offset of the first reachable record of the split, or null) and until
    (where the record ends that comes in from an earlier split, or null).
    """
    within = Window.partitionBy("file", "stretch").orderBy("place")
    sized = found.select("file", "stretch", "place", "size", "record").withColumn("inside", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sized = space.save(sized, "sized")
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = sized.groupBy("file", "stretch").agg(F.count("*").alias("stretches"), F.sum("size").alias("total"))
    # what stands before a file's first magic was counted as a candidate with a magic of its own
    splits = space.save(splits.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)) - len(MAGIC)), "splits")
    placed = sized.join(F.broadcast(splits.select("file", "stretch", "base")), ["file", "stretch"]).withColumn("at", F.col("base") + F.col("inside"))
    placed = placed.filter("at >= 0").select("file", "stretch", "at", (F.col("at") + F.col("record")).alias("next"))
    order = Window.partitionBy("file", "stretch").orderBy("at")
    placed = space.save(placed.withColumn("follows", F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False))).withColumn("after", F.lead("at").over(order)), "placed")
    # a jump elsewhere than to the next candidate of the split makes its target the head of a run
    jumps = placed.filter("next is not null and (after is null or next <> after)").select("file", F.col("next").alias("at")).distinct()
    runs = placed.join(jumps.withColumn("target", F.lit(True)), ["file", "at"], "left").withColumn("head", (~F.col("follows")) | F.coalesce("target", F.lit(False)))
    runs = runs.withColumn("run", F.max(F.when(F.col("head"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nodes = space.save(runs.groupBy("file", "stretch", "run").agg(F.max_by("next", "at").alias("next")), "runs")
    there = nodes.select("file", F.col("run").alias("next"), F.lit(True).alias("there"))
    links = nodes.select("file", "run", "next").join(there, ["file", "next"], "left").select("file", "run", F.when(F.col("there"), F.col("next")).alias("next"))
    links = space.save(links, "links-0")
    reached = links.filter("run = 0").select("file", "run")
    turn = 0
    while True:
        turn += 1
        ahead = links.filter("next is not null").select("file", "run", "next")
        reached = space.save(reached.union(reached.join(ahead, ["file", "run"]).select("file", F.col("next").alias("run"))).distinct(), f"reached-{turn}")
        if not ahead.limit(1).count():
            break
        links = space.save(links.join(ahead.select("file", F.col("run").alias("next"), F.col("next").alias("far")), ["file", "next"], "left").select("file", "run", F.col("far").alias("next")), f"links-{turn}")
    kept = nodes.join(reached, ["file", "run"]).groupBy("file", "stretch").agg(F.min("run").alias("entry"), F.max("next").alias("leaves"))
    said = splits.join(kept, ["file", "stretch"], "left")
    return space.save(said.withColumn("until", F.last("leaves", ignorenulls=True).over(earlier)).drop("leaves"), "chained")


HEADER = {"type": "WARC-Type", "id": "WARC-Record-ID", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To", "content_length": "Content-Length"}
NUMBERS = ("payload_length", "content_length")
PATTERNS = {name: re.compile(rf"(?:^|\n){field}: *{DIGITS if name in NUMBERS else r'([^\r\n]*)'}".encode(), re.IGNORECASE) for name, field in HEADER.items()}


def parse(record: bytes) -> tuple[dict, int | None]:
    """A record's header fields, its content (cut where the record is), and its length with the blank lines after it, if the header says so."""
    head, blank, rest = record[len(MAGIC) :].partition(b"\r\n\r\n")
    found = {name: (m[1].decode(errors="replace") or None) if (m := pattern.search(head)) else None for name, pattern in PATTERNS.items()}
    found |= {name: None if found[name] is None else int(found[name]) for name in NUMBERS}
    if not blank or found["content_length"] is None:
        return found | {"content": b""}, None
    return found | {"content": rest[: found["content_length"]]}, len(MAGIC) + len(head) + 4 + found["content_length"] + 4


FIELDS = [(name, pa.int64() if name in NUMBERS else pa.string()) for name in HEADER]
PIECE = [("file", pa.string()), ("ends", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())]


def _content(whole: bool) -> list[tuple[str, pa.DataType]]:
    return [("payload", pa.binary())] if whole else [("content_bytes", pa.int64()), ("content_sha1", pa.string())]


def _read_row(record: bytes, whole: bool) -> dict:
    fields, _ = parse(record)
    content = fields.pop("content")
    return fields | ({"payload": content} if whole else {"content_bytes": len(content), "content_sha1": hashlib.sha1(content).hexdigest()})


def _walk(whole: bool):
    """The records that lie within a split, and the pieces of those that cross its ends; rows come split by split, in order."""
    schema = pa.schema([*FIELDS, *_content(whole), *PIECE])
    names = ["file", "stretch", "stretches", "total", "base", "entry", "until"]

    def walk(split: tuple, rows: Iterator[bytes]) -> Iterator[dict]:
        file, _, stretches, total, at, entry, until = split
        if at is None:
            raise ValueError("a split was not there when its file was read before")
        seen = size = 0
        held: list[bytes] = []  # the record that goes on
        start = expected = None
        for value in rows:
            seen, size = seen + 1, size + len(value) + len(MAGIC)
            body = MAGIC.encode() + value
            if at >= 0 and entry is not None and at == (entry if start is None else expected):
                if held:
                    yield _read_row(b"".join(held), whole)
                held, start = [body], at
                length = parse(body)[1]
                expected = None if length is None else at + length
            elif start is not None:
                if expected is not None:  # else the chain has ended
                    held.append(body)
            elif until is not None and 0 <= at < until:
                yield {"file": file, "ends": until, "at": at, "piece": body[: until - at]}
            at += len(body)
        if held and expected is not None and at < expected - 4:
            yield {"file": file, "ends": expected, "at": start, "piece": b"".join(held)}
        elif held:
            yield _read_row(b"".join(held), whole)
        if (seen, size) != (stretches, total):
            raise ValueError("a split has other bounds than when its file was read before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, bytes]]:
            for batch in batches:
                for *split, value in zip(*(batch.column(c).to_pylist() for c in [*names, "value"]), strict=True):
                    yield tuple(split), value

        ready, held = [], 0
        for _, row in _by_split(rows(), walk):
            ready.append(row)
            held += len(row.get("payload") or row.get("piece") or b"") + 100
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready, held = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return run


def _by_split(rows: Iterator[tuple[tuple, bytes]], walk) -> Iterator[tuple[tuple, dict]]:
    pending = next(rows, None)
    while pending is not None:
        split = pending[0]

        def same() -> Iterator[bytes]:
            nonlocal pending
            while pending is not None and pending[0] == split:
                yield pending[1]
                pending = next(rows, None)

        for row in walk(split, same()):
            yield split, row


def _join_pieces(whole: bool):
    schema = pa.schema([*FIELDS, *_content(whole)])

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        record = b"".join(pieces.sort_by("at").column("piece").to_pylist())
        return pa.Table.from_pylist([_read_row(record, whole)], schema)

    return run


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{name} {kinds[kind]}" for name, kind in fields)


def read_warc(path: str, space: Workspace, payload: bool = True) -> DataFrame:
    """The records of all WARC files below a path: type, id, uri, digest, payload_length, refers_to, content_length, and payload (or content_bytes and content_sha1).

    Uncompressed WARC 1.1 files of any size, in splits; a record that ends beyond its file is
    cut there. Bytes that no chain from a file's start reaches are part of the record before them; a
    record whose header can't be read ends its file's chain and has no content.
    """
    with pinned_splits(space.spark):
        files = space.spark.read.option("lineSep", MAGIC).text(path)
        chained = chained_splits(candidates(files), space)
        rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"), F.col("value").cast("binary").alias("value"))
        # a row for each split of the files, whatever they hold
        rows = rows.join(F.broadcast(chained), ["file", "stretch"], "left").select("file", "stretch", "stretches", "total", "base", "entry", "until", "value")
        fields = [*FIELDS, *_content(payload)]
        walked = space.save(rows.mapInArrow(_walk(payload), _ddl([*fields, *PIECE])), "walked")
    names = [name for name, _ in fields]
    crossing = walked.filter("ends is not null").select("file", "ends", "at", "piece").groupBy("file", "ends").applyInArrow(_join_pieces(payload), _ddl(fields))
    return walked.filter("ends is null").select(*names).union(crossing)


def archive_digests(pages: DataFrame, dedup_bytes: int = 1000) -> DataFrame:
    """Writes the rows of ``pages`` as WARC files and reads them back: a row for each record.

    Returns page_id, payload_bytes and payload_digest (SHA-1) of the full payload, record_type,
    refers_to (the response's page_id for a revisit, else null), digest_ok (the payload that a
    response has, as read back, has the digest that its header names; of revisits null).
    Of responses bytes and digest are those of the payload read; a revisit has none, and its
    header names them. Null html is an empty payload, null page ids stay null (and revisit any
    equal payload with an id), repeated rows give a record each, an empty table no rows.
    """
    space = Workspace(pages.sparkSession, "warc")
    write_warc(pages, f"{space.path}/archive", space, dedup_bytes)
    records = read_warc(f"{space.path}/archive", space, payload=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:([-0-9]+)>', 1) AS BIGINT)")
    named = F.regexp_replace("digest", "^sha1:", "")
    response = F.col("type") == "response"
    return records.select(
        number("id").alias("page_id"), F.when(response, F.col("content_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(response, F.col("content_sha1")).otherwise(named).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), F.when(response, F.col("content_sha1") == named).alias("digest_ok"),
    )


#: The same rows, straight from the pages.
DIGESTS_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS largest FROM k),
r AS (SELECT *, coalesce(largest > page_id, largest IS NOT NULL) AS again FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN largest END AS refers_to, CASE WHEN NOT again THEN true END AS digest_ok
FROM r
"""
