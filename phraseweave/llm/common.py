"""Pieces that the corpus operators share: stored intermediate tables, Arrow word splitting, hashing.

Intermediate tables are written under ``spark.checkpoint.dir`` (a folder that every
executor reaches), so that a lost executor costs a recomputation of single tasks only and
a chunk or block, once written, never changes when a task is tried again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseweave.session import hadoop_path, scratch_folder, stored

#: Words of a text: lower-cased ASCII letters, digits and every character outside ASCII.
WORD_BYTES = bytes(
    c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256)
)
#: Lower-cases A-Z and leaves white space as the only separator.
SPACE_BYTES = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))

U64 = np.uint64
#: The C library's call that returns free memory, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Workspace:
    """A folder of stored tables below the cluster's shared checkpoint folder, removed when the session's JVM ends.

    Without such a folder a session on one machine gets a temporary one; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_folder(spark, name)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        where = f"{self.path}/{table}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows from a checkpoint, for tables of a few numbers a row: no folder and no footer for each task."""
        name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "false")
        try:
            return stored(df)
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def drop(self, table: str) -> None:
        files, path = hadoop_path(self.spark, f"{self.path}/{table}")
        files.delete(path, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null ids fall into fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def release() -> None:
    """Gives memory that this worker has freed back to the machine, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``most`` bytes of text (one row at least)."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            run = np.cumsum(size, dtype=np.int64) // most
            cut = np.flatnonzero(np.diff(run)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                yield batch.slice(int(a), int(b - a))
    finally:
        release()


def split_words(texts: pa.Array, table: bytes = WORD_BYTES) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat words of all texts; null texts have none.

    ``table`` maps each UTF-8 byte to a byte, so the text buffer is rewritten in one call and
    keeps its offsets; splitting runs in Arrow.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    _, offsets, data = texts.buffers()
    start = np.frombuffer(offsets, np.int32, len(texts) + 1 + texts.offset)[texts.offset :]
    mapped = (data.to_pybytes() if data else b"").translate(table)
    texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(start)), pa.py_buffer(mapped))
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if full.all():
        return at - at[0], flat
    return np.concatenate([[0], np.cumsum(full)])[at - at[0]], flat.filter(pa.array(full))


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words they stand for."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct.to_pylist()), U64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ratio(threshold: float | str) -> tuple[int, int]:
    """The threshold as an exact fraction, so that ties at it are decided in integers."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())
