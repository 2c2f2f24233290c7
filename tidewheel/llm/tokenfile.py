"""Token ids in patched frame-of-reference segments.

A segment holds whole documents in order. Its ids are cut into blocks of 128. A block stores
its minimum, the differences packed at the width that holds a chosen percentile of them, and
a list of exceptions (place, high bits) for the rest. An index has where each block starts,
so one block can be read without the others. Segments are rows of a Parquet table: Spark's
committer then makes the files whole or absent when tasks are retried, in any store.

Segment bytes, little-endian: magic ``TWPF``, u32 documents, u64 ids, u32 blocks; i64 ids of
documents, u8 null flags, u64 lengths; per block u32 minimum, u8 width, u8 exceptions,
u32 start of its packed bits, u32 start of its exceptions; packed bits; u8 exception places;
u32 exception high bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, slices
from .encoding import crc32_ids
from .encoding import encoder as encoder_of

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
MAGIC = b"TWPF"
HEAD = struct.Struct("<4sIQI")


#: Bit lengths of 16-bit numbers.
BITS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def bit_lengths(x: np.ndarray) -> np.ndarray:
    if not x.size or x.max() < 1 << 16:
        return BITS[x]
    return np.where(x < 1 << 16, BITS[x & 0xFFFF], BITS[x >> 16] + np.uint8(16))


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, dtype=np.uint32)
    values[:n] = ids
    values[n:] = ids[-1] if n else 0
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    gaps = values - low[:, None]
    bits = bit_lengths(gaps)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    count = over.sum(axis=1).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), dtype=np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        which = np.flatnonzero(width == w)
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        flags = np.unpackbits(gaps[which].astype(kind).view(np.uint8).reshape(len(which), BLOCK, kind.itemsize), axis=2, bitorder="little")
        packed[starts[which][:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(flags[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
    places = np.nonzero(over)
    high = (gaps[places] >> width[places[0]].astype(np.uint32)).astype("<u4")
    exceptions = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[:-1]
    return b"".join(
        (
            HEAD.pack(MAGIC, len(doc_ids), n, blocks),
            np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
            np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
            np.array(lengths, dtype="<u8").tobytes(),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            count.tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            exceptions.astype("<u4").tobytes(),
            packed.tobytes(),
            places[1].astype(np.uint8).tobytes(),
            high.tobytes(),
        )
    )


class Segment:
    """A packed segment's parts; blocks are decoded when asked for."""

    def __init__(self, raw: bytes):
        magic, docs, self.n, self.blocks = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if no else int(i) for i, no in zip(ids, null, strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.low, self.width, self.count = take("<u4", self.blocks), take("u1", self.blocks), take("u1", self.blocks)
        self.starts, self.exceptions = take("<u4", self.blocks).astype(np.int64), take("<u4", self.blocks).astype(np.int64)
        self.packed = take("u1", int(self.width.astype(np.int64).sum()) * BLOCK // 8)
        total = int(self.count.astype(np.int64).sum())
        self.places, self.high = take("u1", total), take("<u4", total)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last (exclusive)."""
        last = self.blocks if last is None else last
        width = self.width[first:last]
        out = np.zeros((last - first, BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if not w:
                continue
            which = np.flatnonzero(width == w)
            raw = self.packed[self.starts[first + which][:, None] + np.arange(int(w) * BLOCK // 8)]
            flags = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
            total = np.zeros((len(which), BLOCK), dtype=np.uint32)
            for b in range(int(w)):
                total |= flags[:, :, b].astype(np.uint32) << np.uint32(b)
            out[which] = total
        count = self.count[first:last].astype(np.int64)
        if count.sum():
            a = int(self.exceptions[first])
            rows = np.repeat(np.arange(last - first), count)
            places = self.places[a : a + len(rows)]
            out[rows, places] |= self.high[a : a + len(rows)] << width[rows].astype(np.uint32)
        out += self.low[first:last][:, None]
        return out.reshape(-1)[: max(0, min(self.n, last * BLOCK) - first * BLOCK)]


SEGMENTS = "part int, segment int, first_id long, n_ids long, payload binary"


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, spaced: bool = True, segment_ids: int = SEGMENT_IDS, count: int | None = None) -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each and writes segments in ascending doc_id order.

    Null doc_ids come first, repeated ones next to each other in an order set by their texts.
    One range shuffle of the texts orders them; a task holds one segment at a time. A document
    longer than a segment has a segment of its own. An empty table writes no segment. Columns
    other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "_tie"]
    dealt = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(count or partitions(spark, documents), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, spaced)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        first = segment = held = 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal first, segment, held
            payload = pack(np.concatenate(ids), docs, [len(x) for x in ids])
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_id": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            first, segment, held = first + held, segment + 1, 0
            docs.clear()
            ids.clear()
            return row

        for batch in batches:
            for rows_, texts in slices(batch, limit=3 << 19):
                for doc, raw in zip(rows_.column(0).to_pylist(), encoder.encode([t.decode() for t in texts]), strict=True):
                    own = np.concatenate([raw.astype(np.uint32), end])
                    if held and held + len(own) > segment_ids:
                        yield flush()
                    docs.append(doc)
                    ids.append(own)
                    held += len(own)
        if held:
            yield flush()

    dealt.mapInArrow(run, SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids_crc32 or else ids, from the files.

    Only the number of ids of each written part comes to the driver (one row per part file).
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    base, before = [], 0
    for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base.append((r["part"], before))
        before += r["n"]
    bases = spark.createDataFrame(base, "part int, before long")
    last = "ids_crc32 long" if digest else "ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(raw.as_py())
                ids = segment.decode()
                ends = np.cumsum(segment.lengths)
                own = [ids[e - n : e] for e, n in zip(ends, segment.lengths, strict=True)]
                values = pa.array([crc32_ids(x) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(start + ends - segment.lengths), pa.array(segment.lengths), values], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return segments.join(F.broadcast(bases), "part").select((F.col("before") + F.col("first_id")).alias("start"), "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
