"""Benchmark decontamination with one Aho-Corasick automaton over words.

Benchmark texts are normalised to words (see ``alnum_words``); a pattern is 13 consecutive
words of an item, or all words of a shorter one. The automaton runs over word numbers, so
each document is scanned once in time linear in its words, whatever the number of patterns.
Word positions are mapped back to character offsets of the original text.

A null or empty text has no words and is never contaminated. Items without words are left
out; rows that repeat an item_id are one item. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, checkpointed, slices

WINDOW = 13
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Patterns:
    """Windows of one block of the benchmark, and the automaton over them, built once in each worker."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.items, self.window, self.automaton = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "automaton": None}

    def build(self) -> Patterns:
        if self.automaton is None:
            self.numbers: dict[bytes, int] = {}
            owners: dict[tuple[int, ...], set[int]] = {}
            for item, raw in self.items:
                words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(raw)]
                n = min(self.window, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    owners.setdefault(tuple(words[i : i + n]), set()).add(item)
            self.owners = list(owners.values())
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, pattern in enumerate(owners):
                self.automaton.add_word(pattern, (len(pattern), k))
            if owners:
                self.automaton.make_automaton()
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit ranges of word positions (end exclusive) and the items that occur."""
        if not self.owners or not words:
            return [], set()
        get = self.numbers.get
        spans: list[list[int]] = []
        seen: set[int] = set()
        for end, (n, k) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            seen.add(k)
            start = end - n + 1
            while spans and start < spans[-1][0]:
                start = min(start, spans.pop()[0])
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end + 1)
            else:
                spans.append([start, end + 1])
        return [(a, b) for a, b in spans], {i for k in seen for i in self.owners[k]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets of the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


NOTHING = hashlib.sha256(b"").hexdigest()


def hits(texts: DataFrame, patterns: Patterns) -> DataFrame:
    """texts: h1, h2, _text. The word ranges and items of those in which something occurs, one row for each h1, h2."""
    broadcast = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value.build()
        for batch in batches:
            for part, raw in slices(batch, "_text"):
                found = [block.scan(alnum_words(x or b"")) for x in raw]
                some = pa.array([i for i, (ranges, _) in enumerate(found) if ranges], pa.int64())
                if len(some):
                    held = [found[i] for i in some.to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(1).take(some), pa.array([ranges_of(r) for r, _ in held], RANGES), pa.array([sorted(x) for _, x in held], pa.list_(pa.int64()))], names=["h1", "h2", "ranges", "items"])

    rows = texts.mapInArrow(run, "h1 long, h2 long, ranges array<struct<first:int,last:int>>, items array<bigint>")
    return rows.groupBy("h1", "h2").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items"))


def concluded(df: DataFrame, patterns: Patterns | None, one_in: int) -> DataFrame:
    """The result columns of df (row, _text): by a scan for ``patterns`` or, without them, from the hits in its column _found."""
    broadcast = df.sparkSession.sparkContext.broadcast(patterns) if patterns else None

    def digest(items: list[int]) -> str:
        return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest() if items else NOTHING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value.build() if broadcast else None
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                counts, spans, items = [], [], []
                known = None if block else part.column(part.schema.get_field_index("_found")).to_pylist()
                for i, raw in enumerate(texts):
                    words = alnum_words(raw or b"")
                    if block:
                        ranges, found = block.scan(words)
                    else:
                        ranges = merged([(x["first"], x["last"]) for f in known[i] or () for x in f["ranges"]])
                        found = {x for f in known[i] or () for x in f["items"]}
                    counts.append(len(words))
                    spans.append(ranges)
                    items.append(sorted(found))
                hit = np.array([sum(b - a for a, b in s) for s in spans], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(part.schema.get_field_index("row")),
                        "n_words": pa.array(counts, pa.int64()),
                        "n_hit": pa.array(hit),
                        "n_items": pa.array([len(x) for x in items], pa.int64()),
                        "item_ids": pa.array(items, pa.list_(pa.int64())),
                        "items_sha256": pa.array([digest(x) for x in items], pa.string()),
                        "spans": pa.array([ranges_of(char_spans(texts[i].decode(), s) if s else []) for i, s in enumerate(spans)], RANGES),
                        "contaminated": pa.array((hit > 0) & (one_in * hit >= np.array(counts, dtype=np.int64))),
                    }
                )

    carry = df.schema["row"].dataType.simpleString()
    return df.mapInArrow(run, f"row {carry}, n_words long, n_hit long, n_items long, item_ids array<bigint>, items_sha256 string, spans array<struct<first:int,last:int>>, contaminated boolean")


def ranges_of(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "last": b} for a, b in spans]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, carry: list[str] | None = None, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: row, n_words, n_hit, n_items, item_ids, items_sha256, spans, contaminated.

    ``row`` is a struct of the columns named in ``carry`` (doc_id alone if none are), so no
    column of the input can clash with the results. ``spans`` are character ranges (end
    exclusive) of the original text. Contaminated: some word is hit, and at least one word in
    ``one_in`` is. The benchmark is measured first and read to the driver in blocks of about
    ``block_bytes``; each block is one automaton, and only one block is held at a time. With
    one block a document is scanned once, without a shuffle. With more, each block is a scan
    of its own, of which only the texts with hits go on, and these are joined to the documents
    by a 128-bit hash of the text.
    """
    tests = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    df = documents.select(F.struct(*[F.col(c) for c in carry or ["doc_id"]]).alias("row"), F.col(text_column).cast("string").alias("_text"))

    def block(b: int) -> Patterns:
        chosen = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else tests
        return Patterns([(r["item"], r["text"].encode()) for r in chosen.distinct().toLocalIterator()], window)

    if blocks == 1:
        return concluded(df, block(0), one_in)
    key = [F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2")]
    texts = df.select(*key, "_text")
    found = reduce(DataFrame.union, [checkpointed(hits(texts, block(b))) for b in range(blocks)])
    found = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("ranges", "items")).alias("_found"))  # one for each block at most
    return concluded(df.select("*", *key).join(found, ["h1", "h2"], "left").select("row", "_text", "_found"), None, one_in)
