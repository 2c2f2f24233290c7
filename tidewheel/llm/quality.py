"""Quality by random-indexing word vectors and a small network.

Words (and, as words of their own, the punctuation that ends them and being in capitals) are
hashed to 2^14 places. Each place has a fixed sparse random vector of signs. A place's word
vector is the sum, over all its occurrences in all documents, of the random vectors of the
words around it. A document is pooled to the mean of its words' vectors, their spread, and a
few counts; a network of two layers in numpy, fitted on at most ``limit`` labelled texts,
turns that into a probability, with a temperature calibrated on texts kept out of the fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, partitions, slices
from .labelled import labelled_texts

BITS, WIDTH, NONZERO, NEAR = 14, 32, 2, 2
PLACES = 1 << BITS
BLOCK_PLACES = 1024
HIDDEN, EPOCHS, BATCH, RATE, SHRINK, LIMIT = 32, 60, 128, 3e-3, 1e-4, 20_000
EXTRA = 6


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Where each place's random vector is not zero, and the signs there."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((PLACES, WIDTH)), axis=1)[:, :NONZERO].astype(np.int64)
    return at, rng.choice(np.array([-1.0, 1.0]), (PLACES, NONZERO))


class Places(dict):
    """A word between spaces -> the places of its letters, its capitals and the punctuation that ends it."""

    TAIL = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        stem = word.rstrip(self.TAIL)
        out = [xxhash.xxh3_64_intdigest(stem.lower(), seed=1) & (PLACES - 1)] if stem else []
        if len(stem) > 1 and stem.isupper():
            out.append(xxhash.xxh3_64_intdigest(b"capitals", seed=2) & (PLACES - 1))
        if len(stem) < len(word):
            out.append(xxhash.xxh3_64_intdigest(word[len(stem) :], seed=3) & (PLACES - 1))
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = tuple(out)
        return tuple(out)

    def of(self, text: bytes | None) -> np.ndarray:
        return np.array([p for w in (text or b"").split() for p in self[w]], dtype=np.int64)


def contexts(ids: np.ndarray, rows: np.ndarray, at: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the random vectors around each place, within a text."""
    out = np.zeros(PLACES * WIDTH)
    for off in range(1, NEAR + 1):
        same = rows[off:] == rows[:-off]
        a, b = ids[:-off][same], ids[off:][same]
        for own, other in ((a, b), (b, a)):
            for j in range(NONZERO):
                out += np.bincount(own * WIDTH + at[other, j], weights=signs[other, j], minlength=PLACES * WIDTH)
    return out


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The vectors of all places, from all documents; of unit length, zero where a place has no occurrence.

    Each task adds up one table of fixed size and gives it in blocks of rows, which are summed
    by block; 2 MB come to the driver whatever the input size.
    """
    at, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total, any_ = Places(), np.zeros(PLACES * WIDTH), False
        for batch in batches:
            for _, texts in slices(batch):
                docs = [places.of(t) for t in texts]
                if sum(map(len, docs)):
                    any_ = True
                    total += contexts(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), at, signs)
        if any_:
            table = total.astype(np.int64).reshape(-1, BLOCK_PLACES * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), pa.array([packed(x) for x in table], pa.binary())], names=["block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + unpacked(raw)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], names=["block", "sums"])

    blocks = PLACES // BLOCK_PLACES
    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "block int, sums binary")
    for spread in (16, 1):  # first in 16 parts of each block, then those
        parts = parts.repartition(min(blocks * spread, partitions(documents.sparkSession)), "block", *([F.pmod(F.xxhash64("sums"), F.lit(spread))] if spread > 1 else [])).mapInArrow(added, "block int, sums binary")
    out = np.zeros((blocks, BLOCK_PLACES * WIDTH))
    for row in parts.toArrow().to_pylist():
        out[row["block"]] += unpacked(row["sums"])
    vectors = out.reshape(PLACES, WIDTH)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0).astype(np.float32)


def packed(values: np.ndarray) -> bytes:
    narrow = values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values
    return narrow.dtype.char.encode() + zlib.compress(narrow.astype(narrow.dtype.newbyteorder("<")).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), dtype="<" + raw[:1].decode()).astype(np.int64)


def pooled(docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors, its length, how often it repeats itself, and the length of the mean."""
    out = np.zeros((len(docs), 2 * WIDTH + EXTRA))
    for i, ids in enumerate(docs):
        if not len(ids):
            continue
        kinds, counts = np.unique(ids, return_counts=True)
        v = vectors[kinds].astype(np.float64)
        mean = counts @ v / len(ids)
        out[i, :WIDTH] = mean
        out[i, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(0, counts @ v**2 / len(ids) - mean**2))
        same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
        out[i, 2 * WIDTH :] = [np.log1p(len(ids)), len(kinds) / len(ids), counts.max() / len(ids), same, np.log1p(counts.mean()), np.linalg.norm(mean)]
    return out


@dataclass
class Network:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def trained(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 13) -> Network:
    """Adam on the logistic loss of four fifths of the texts; the temperature is the one with least loss on the rest."""
    rng = np.random.default_rng(seed)
    width = 2 * WIDTH + EXTRA
    apart = np.arange(len(y)) % 5 == 0
    fx, fy = x[~apart], y[~apart]
    shift, scale = (fx.mean(axis=0), fx.std(axis=0) + 1e-6) if len(fx) else (np.zeros(width), np.ones(width))
    rate = np.clip(fy.mean() if len(fy) else 0.5, 1e-3, 1 - 1e-3)
    net = Network(vectors, shift, scale, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(rate / (1 - rate))), 1.0)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    z = (fx - shift) / scale
    for epoch in range(EPOCHS if len(fy) else 0):
        order = rng.permutation(len(fy))
        for a in range(0, len(fy), BATCH):
            batch = order[a : a + BATCH]
            h = np.tanh(z[batch] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - fy[batch]) / len(batch)
            back = error[:, None] * weights[2] * (1 - h**2)
            slopes = [z[batch].T @ back + SHRINK * weights[0], back.sum(axis=0), h.T @ error + SHRINK * weights[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * 0.97**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if apart.any():
        raw, want = net.raw(x[apart]), y[apart]
        losses = {t: np.mean(np.logaddexp(0, raw / t) - want * raw / t) for t in np.geomspace(0.25, 8, 41)}
        net.temperature = float(min(losses, key=losses.__getitem__))
    return net


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LIMIT) -> Network:
    """Word vectors from all documents, the network from labelled rows outside the held-out fold."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(list(pooled([places.of(t) for t in texts], shared.value)), pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    got = labelled_texts(documents, labels, label, limit).mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.concatenate([np.empty(0), *(np.asarray(c.flatten()) for c in got.column("x").chunks)]).reshape(-1, 2 * WIDTH + EXTRA)
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)
    order = np.lexsort([*x.T[:3], y])
    mixed = np.random.default_rng(17).permutation(len(order))
    return trained(x[order][mixed], y[order][mixed], vectors)


def score(documents: DataFrame, network: Network, carry: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """row (a struct of the columns in ``carry``, doc_id alone if none), held_out, score, predicted: one row per document.

    A null or empty text is pooled to zeros and scored like any other. Scores come from the
    text alone. An empty table gives no row; without labelled rows every score is 0.5.
    """
    shared = documents.sparkSession.sparkContext.broadcast(network)  # 2^14 x 32 floats at any input size
    df = documents.select(F.struct(*[F.col(c) for c in carry or ["doc_id"]]).alias("row"), fold().eqNullSafe(F.lit(0)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            for part, texts in slices(batch, limit=1 << 20):
                s = shared.value.scores(pooled([places.of(t) for t in texts], shared.value.vectors))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, held_out boolean, score double, predicted int")
