"""Toxicity by a factorization machine over hashed words.

A document is the set of its words (A-Z lower-cased) and of their beginnings of 4 and 5 bytes,
which inflected forms share, hashed to 2^18 places. Besides a weight
for each word, the machine learns a short vector for each; the products of the vectors of
words that stand in one text add what a pair means beyond its words. It is fitted on the
driver on at most ``limit`` labelled texts with ``LIMIT_TERMS`` terms in all; scoring is one
pass without a shuffle.

A term takes part if it says something: alone (its texts are toxic clearly more or less often
than texts are), or in a pair (the texts that hold both are, by more than either of the two
or their product would make them). So words that mean nothing alone are learned from the
pairs that they form; all other terms keep weight 0, else the many chance words of long texts
would add up. Pairs are counted among the ``PAIR_TERMS`` terms that stand in most texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, checkpointed, fold, slices
from .labelled import labelled_texts

BITS, FACTORS, EPOCHS, BATCH, LIMIT = 18, 8, 30, 64, 20_000
#: Distinct terms of all texts of the fit (4 bytes each).
LIMIT_TERMS = 16_000_000
#: Step, its decay per epoch, L2 pull on weights and on vectors.
RATE, DECAY, SHRINK, SHRINK_PAIRS = 0.5, 0.95, 1e-5, 1e-3
#: Terms and pairs in fewer texts say nothing; nor do those whose share of positives is within so many standard errors of what is expected.
LEAST, STANDARD_ERRORS = 4, 5.0
#: Terms that pairs are counted of, and standard errors for them, more as there are two million pairs.
PAIR_TERMS, PAIR_ERRORS = 2048, 10.0


def terms(words: list[bytes]) -> list[bytes]:
    whole = set(words)
    return [*whole, *{w[:4] + b"-" for w in whole if len(w) > 4}, *{w[:5] + b"-" for w in whole if len(w) > 5}]


def features(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, one after the other, and how many each has."""
    sets = [np.unique(hashes.of(terms(alnum_words(t or b""))) >> np.uint64(64 - BITS)).astype(np.int64) for t in texts]
    return (np.concatenate(sets) if sets else np.empty(0, np.int64)), np.array([len(s) for s in sets], dtype=np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; zero for empty groups."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = self.vectors[index]
        pairs = 0.5 * (sums(v, counts) ** 2 - sums(v * v, counts)).sum(axis=1)
        return self.bias + sums(self.weights[index], counts) + pairs

    def scores(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, counts), -30, 30)))


def parts(counts: np.ndarray, size: int = 500) -> Iterator[tuple[slice, slice]]:
    """Ranges of texts and of their terms."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(counts), size):
        b = min(a + size, len(counts))
        yield slice(a, b), slice(int(ends[a]), int(ends[b]))


def telling(index: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each term says something, alone or in a pair."""
    size = 1 << BITS
    n, hits = np.zeros(size), np.zeros(size)
    for texts, at in parts(counts):
        n += np.bincount(index[at], minlength=size)
        hits += np.bincount(index[at], weights=np.repeat(y[texts], counts[texts]), minlength=size)
    rate = y.mean() if len(y) else 0.5
    off = np.abs(hits - rate * n) / np.sqrt(np.maximum(rate * (1 - rate) * n, 1e-9))
    out = (n >= LEAST) & (off > STANDARD_ERRORS)
    if 0 < rate < 1:
        out |= telling_in_pairs(index, counts, y, n, hits / np.maximum(n, 1), rate)
    return out


def telling_in_pairs(index: np.ndarray, counts: np.ndarray, y: np.ndarray, n: np.ndarray, share: np.ndarray, rate: float) -> np.ndarray:
    """Terms of a pair whose texts are positive more often, or less often, than the shares of both terms account for."""
    common = np.argsort(-n, kind="stable")[:PAIR_TERMS]
    common = common[n[common] >= LEAST]
    place = np.full(len(n), -1)
    place[common] = np.arange(len(common))
    both, bad = np.zeros((2, len(common), len(common)), np.float32)
    for texts, at in parts(counts):
        rows, columns = np.repeat(np.arange(texts.stop - texts.start), counts[texts]), place[index[at]]
        held = np.zeros((texts.stop - texts.start, len(common)), np.float32)
        held[rows[columns >= 0], columns[columns >= 0]] = 1
        both += held.T @ held
        held = held[y[texts] == 1]
        bad += held.T @ held
    out = np.zeros(len(n), dtype=bool)
    shares = share[common]
    for a in range(0, len(common), 256):
        own = shares[a : a + 256, None]
        expected = np.stack(np.broadcast_arrays(own, shares, rate, np.minimum(own * shares / rate, 1)))
        low, high = expected.min(axis=0), expected.max(axis=0)
        seen, positive = both[a : a + 256], bad[a : a + 256]
        above, below = positive - high * seen, low * seen - positive
        bound = np.where(above > 0, high, low)
        clear = np.maximum(above, below) > PAIR_ERRORS * np.sqrt(np.maximum(bound * (1 - bound) * seen, 1))
        out[common[a : a + 256]] = (clear & (seen >= LEAST)).any(axis=1)
    return out


def fitted(index: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss, over the telling terms. Without any text all scores are low."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    known = telling(index, counts, y)
    kept = [(index[at][own := known[index[at]]], np.repeat(np.arange(texts.start, texts.stop), counts[texts])[own]) for texts, at in parts(counts)]
    index = np.concatenate([k[0] for k in kept]) if kept else index
    rows = np.concatenate([k[1] for k in kept]) if kept else index
    counts = np.bincount(rows, minlength=len(counts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    used, own = np.unique(index, return_inverse=True)
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    gw, gv, gb = np.full(len(used), 1e-3), np.full(v.shape, 1e-3), 1e-3
    rate = np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    for epoch in range(EPOCHS if len(used) else 0):
        step = RATE * DECAY**epoch
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            batch = order[a : a + BATCH]
            n = counts[batch]
            at = np.concatenate([own[starts[i] : starts[i + 1]] for i in batch])
            vi = v[at]
            total = sums(vi, n)
            raw = bias + sums(w[at], n) + 0.5 * (total**2 - sums(vi * vi, n)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]
            each = np.repeat(error, n)
            ids, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, weights=each, minlength=len(ids)) / len(batch) + SHRINK * w[ids]
            pull = each[:, None] * (np.repeat(total, n, axis=0) - vi)
            dv = np.stack([np.bincount(inverse, weights=pull[:, f], minlength=len(ids)) for f in range(FACTORS)], axis=1) / len(batch) + SHRINK_PAIRS * v[ids]
            gw[ids] += dw**2
            gv[ids] += dv**2
            w[ids] -= step * dw / np.sqrt(gw[ids])
            v[ids] -= step * 0.1 * dv / np.sqrt(gv[ids])
            db = error.mean()
            gb += db**2
            bias -= step * db / np.sqrt(gb)
    weights, vectors = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    weights[used], vectors[used] = w, v
    return Machine(bias, weights, vectors)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT, limit_terms: int = LIMIT_TERMS) -> Machine:
    """Learns from labelled rows outside the held-out fold; without any, every score is near 0.

    At most ``limit`` rows, chosen by hash, of which the first by hash are taken that have
    ``limit_terms`` terms in all. So what comes to the driver is bounded, however long texts
    are. Labels of rows without an id or text row, and those other than 0 and 1, are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch):
                index, counts = features(texts, hashes)
                sets = [x.astype("<u4").tobytes() for x in np.split(index, np.cumsum(counts)[:-1])] if len(counts) else []
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in sets], pa.int64()), pa.array(sets, pa.binary()), part.column(1)], names=["h", "words", "y"])

    # in a fixed order, and copies once, else the terms of a text with many copies look telling
    found = checkpointed(labelled_texts(documents, labels, label, limit).mapInArrow(run, "h long, words binary, y int").dropDuplicates(["h", "y"]))
    sizes = found.select("h", "y", (F.octet_length("words") / 4).alias("n")).toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    few = int(np.searchsorted(np.cumsum(np.asarray(sizes.column("n"))), limit_terms, side="right"))
    chosen = found if few == sizes.num_rows else found.where(F.col("h") < sizes.column("h")[few].as_py())
    got = chosen.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    words, y = got.column("words"), np.asarray(got.column("y"), dtype=np.float64)
    index = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x.as_buffer(), dtype="<u4").view(np.int32) for x in words if len(x.as_buffer()))])
    return fitted(index, np.array([len(x.as_buffer()) // 4 for x in words], dtype=np.int64), y)


def score(documents: DataFrame, machine: Machine, carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """row (a struct of the columns in ``carry``, doc_id alone if none), held_out, score, predicted: one row per document.

    A null or empty text has no words and gets the score of the bias. Scores come from the
    text alone, so repeated rows have equal ones. An empty table gives no row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # 2^18 x (8 + 1) floats at any input size
    df = documents.select(F.struct(*[F.col(c) for c in carry or ["doc_id"]]).alias("row"), fold().eqNullSafe(F.lit(0)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch, limit=1 << 20):
                s = shared.value.scores(*features(texts, hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, held_out boolean, score double, predicted int")
