"""Helpers that the corpus operators share: words, Arrow batches, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z, keeps digits, letters and every byte of a non-ASCII character, turns the rest into a space.
ALNUM = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Lower-cases A-Z only.
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 4 << 20
#: Bytes of the input's files for each partition of a shuffle, at most.
PART_BYTES = 256 << 20


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(ALNUM).split()


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(LOWER).split()


class WordHashes(dict):
    """word bytes -> 64-bit hash as a Python int; forgets everything when it holds too many words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence if it is shorter, nothing if it is empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = mix(words[:m], n)
        for i in range(1, n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m], i)
    return np.unique(h)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Row ranges of a batch whose texts have about ``limit`` bytes, with the texts as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 20_000]), limit, side="right")))
        yield batch.slice(at, n), column.slice(at, n).to_pylist()
        at += n


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for very long texts, unless the session has sizes of its own. They change no result."""
    own = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if key not in own:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a single machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage, whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage like ``checkpointed``, in a folder that the caller removes with ``delete_path`` once nothing reads it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession, source: DataFrame | None = None) -> int:
    """Partitions of a shuffle: those of the session, and more where the files of ``source`` would give each over PART_BYTES."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if source is not None:
        leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
        files = [leaves.apply(i) for i in range(leaves.size())]
        size = sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")
        n = max(n, -(-size // PART_BYTES))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; remainder 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with one key, from batches sorted by it. Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
