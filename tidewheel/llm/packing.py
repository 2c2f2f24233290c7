"""Packing along a space-filling curve.

A document's ids are counted in a few hundred hashed buckets, the counts' square roots are
scaled to unit length and projected to four dimensions, and the place on a Hilbert curve
through those dimensions is the document's key. Documents are range-sorted by key, so
neighbours in a sequence are alike, and each range is cut into full sequences as one long
stream. The rest of a range is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, slices
from .encoding import crc32_ids
from .encoding import encoder as encoder_of

LENGTH = 2048
BUCKETS, DIMENSIONS, BITS = 256, 4, 8


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of unsigned integers below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    flat = np.concatenate(ids).astype(np.int64)
    buckets = ((flat * 2_654_435_761) & 0xFFFFFFFF) >> 24
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    counts = np.sqrt(np.bincount(rows * BUCKETS + buckets, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS))
    counts /= np.linalg.norm(counts, axis=1, keepdims=True)
    cells = (1 + np.tanh(counts @ matrix)) * (1 << (BITS - 1))
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def encoded(documents: DataFrame, tokenizer: str, end_id: int, spaced: bool) -> DataFrame:
    """doc_id, Hilbert key, number of ids and the ids (with the end id) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, spaced)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        matrix = projection()
        for batch in batches:
            for part, texts in slices(batch, limit=3 << 19):
                raw = [x.tobytes() + end for x in encoder.encode([(t or b"").decode() for t in texts])]
                ids = [np.frombuffer(x, dtype=encoder.dtype) for x in raw]
                keys = np.concatenate([document_keys(ids[a : a + 512], matrix) for a in range(0, len(ids), 512)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([encoder.dtype.itemsize] * len(ids), pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "key", "n", "width", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, n long, width int, ids binary")


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, spaced: bool = False, length: int = LENGTH, count: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Sequences have at most ``length`` ids; all but a few at the end of each of the ``count``
    key ranges have exactly that many, and those few have a power of two, so nothing is
    padded. A null or empty text is its end id alone. Null doc_ids and repeated rows are
    packed like any other row. An empty table gives no piece. Other columns are not read.
    Texts are encoded once: the ids are checkpointed, as a range sort reads its input twice.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = documents.sparkSession
    rows = checkpointed(encoded(documents, tokenizer, end_id, spaced)).withColumn("tie", F.xxhash64("ids"))
    order = ["key", "doc_id", "tie"]
    dealt = rows.repartitionByRange(count or partitions(spark, documents), *order).sortWithinPartitions(*order).select("doc_id", "n", "width", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, offset = 0, 0
        open_: list[list] = []

        def table(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in (columns[0], columns[1], [len(x) for x in columns[2]], [crc32_ids(x) for x in columns[2]], *columns[3:])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tolist() for x in columns[2]], pa.list_(pa.int64()))] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

        for batch in batches:
            full: list[list] = []
            for doc, n, width, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4")
                at = 0
                while at < n:
                    take = min(length - offset, n - at)
                    open_.append([doc, at, ids[at : at + take], n, base | sequence, offset])
                    at, offset = at + take, offset + take
                    if offset == length:
                        full += open_
                        open_, sequence, offset = [], sequence + 1, 0
            if full:
                yield table(full)
        rest, total, done, sizes = [], offset, 0, []
        while total:  # the highest power of two in what is left
            sizes.append(1 << (total.bit_length() - 1))
            total -= sizes[-1]
        for doc, start, ids, n, _, at in open_:
            taken = 0
            while taken < len(ids):
                while at + taken >= done + sizes[0]:
                    done += sizes.pop(0)
                    sequence += 1
                inside = at + taken - done
                take = min(sizes[0] - inside, len(ids) - taken)
                rest.append([doc, start + taken, ids[taken : taken + take], n, base | sequence, inside])
                taken += take
        if rest:
            yield table(rest)

    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names) + (", ids array<bigint>" if with_ids else ""))
