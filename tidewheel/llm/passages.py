"""Repeated passages by a sparse suffix array.

Suffixes are kept only at content-selected places: where the hash of 6 words is the least in
some run of 24 such hashes. Any passage of 50 words has such a place among its first 24, with
at least 27 of its words from there on, so equal passages keep suffixes at equal places, and
a suffix stands for the passages that begin up to 23 words before it.

1. The first 27 words of every kept suffix are hashed. Suffixes whose hash is in one
   document only can be in no repeated passage and are dropped.
2. For the rest, the words of their passages from there on and before are taken, and the
   suffixes sorted by content. Neighbours are compared: suffixes between which all neighbours have r words in
   common have these in common. Those that also agree in the 50 - r words before hold the same
   passage of 50 words; the smallest doc_id among them is its source for all others.
3. What repeats in a document is the union of such passages.

Equal texts are matched as wholes, so copies add no suffixes. A set of more than ``SHARE``
suffixes with equal first words is not sorted, so that no task holds all of a very common
passage: every run of 50 words that such a suffix can stand for is hashed whole, and the
hashes are grouped with their smallest doc_id (partly before the shuffle). The ``TOP`` most
frequent of these hashes, a bounded number, are looked up in memory, the others by a join. All
ways find the same passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, checkpointed, delete_path, mix, partitions, slices, written
from .decontamination import WORD, merged

LENGTH, GRAM, RUN, SHARE, TOP = 50, 6, 24, 20_000, 100_000
CHUNK_ROWS = 20_000


class Selection:
    """What passages of ``length`` words need: the words from a kept place on, and the words before it."""

    def __init__(self, length: int, gram: int = GRAM, run: int = RUN):
        if length < gram + run - 1 or length - run + 1 < gram:
            raise ValueError("passages must be longer than a run of kept places")
        self.length, self.gram, self.run = length, gram, run
        self.head, self.left = length - run + 1, run - 1
        self.factors = mix(np.arange(1, self.head + 1, dtype=np.uint64), 5) | np.uint64(1)

    def extreme(self, x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        """pick over every ``run`` consecutive values."""
        size = 1
        while 2 * size <= self.run:
            x = pick(x[:-size], x[size:])
            size *= 2
        rest = self.run - size
        return pick(x[: len(x) - rest], x[rest:]) if rest else x

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kept places, the hashes of the ``head`` words from there on, and the least and most words before.

        A passage of ``length`` words belongs to the least hash of its own first run, so all
        its occurrences keep a suffix at that place, whatever stands around them. Least and
        most say which passages belong to a place: those that begin so many words before it.
        """
        n = len(words)
        if n < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        m = n - self.gram + 1
        with np.errstate(over="ignore"):
            grams = words[:m].copy()
            for i in range(1, self.gram):
                grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m], i)
            first = self.extreme(grams, np.minimum)[: n - self.length + 1]  # of the run that each passage begins with
            pad = np.zeros(self.run - 1, np.uint64)
            kept = np.flatnonzero(self.extreme(np.concatenate([pad, first, pad]), np.maximum)[: len(first) + self.run - 1] == grams[: len(first) + self.run - 1])
            begin = kept[:, None] - np.arange(self.run)
            inside = (begin >= 0) & (begin < len(first))
            own = inside & (first[np.where(inside, begin, 0)] == grams[kept, None])
            kept, own = kept[some := own.any(axis=1)], own[some]
            heads = mix((words[kept[:, None] + np.arange(self.head)] * self.factors).sum(axis=1, dtype=np.uint64), 9)
        return kept, heads, own.argmax(axis=1), self.run - 1 - own[:, ::-1].argmax(axis=1)


def digests(documents: DataFrame, pick: Selection) -> DataFrame:
    """doc_id, n_words, 128-bit hash of the word sequence, hashes of the kept suffixes' first words and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch):
                words = [hashes.of(alnum_words(t or b"")) for t in texts]
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(w.tobytes()), dtype=np.int64) for w in words]).reshape(-1, 2)
                heads = [np.unique(pick.places(w)[1].view(np.int64), return_counts=True) for w in words]
                ends = np.cumsum([0, *(len(h) for h, _ in heads)])
                counted = pa.StructArray.from_arrays([pa.array(np.concatenate([h for h, _ in heads])), pa.array(np.concatenate([n for _, n in heads]).astype(np.int32))], ["head", "times"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counted)], names=["doc_id", "n", "h1", "h2", "heads"])

    return documents.mapInArrow(run, "doc_id long, n int, h1 long, h2 long, heads array<struct<head:bigint,times:int>>")


def suffixes(texts: DataFrame, pick: Selection) -> DataFrame:
    """texts: doc_id, text, wanted, common (heads).

    A row for each kept suffix with a wanted head, and one with ``key`` and ``key2``, a 128-bit
    hash, and no suffix for each run of ``length`` words that one with a common head stands for.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["key", "key2", "doc_id", "at", "least", "most", "suffix", "before"]
    factors = [mix(np.arange(1, pick.length + 1, dtype=np.uint64), seed) | np.uint64(1) for seed in (6, 7)]

    def runs(doc: int, words: np.ndarray, kept: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
        offsets = np.arange(pick.run)
        starts = np.unique((kept[:, None] - offsets)[(offsets >= least[:, None]) & (offsets <= most[:, None])])
        for a in range(0, len(starts), CHUNK_ROWS):
            at = starts[a : a + CHUNK_ROWS]
            window = words[at[:, None] + np.arange(pick.length)]
            h1, h2 = (mix((window * f).sum(axis=1, dtype=np.uint64), 9).view(np.int64) for f in factors)
            empty = [pa.nulls(len(at), kind) for kind in kinds[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32)), *empty], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, raw in slices(batch, limit=1 << 20):
                rows: list[tuple] = []
                for doc, text, wanted, common in zip(part.column(0).to_pylist(), raw, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = hashes.of(alnum_words(text or b""))
                    kept, heads, least, most = pick.places(words)
                    heads = heads.view(np.int64)
                    short = (words >> np.uint64(32)).astype(">u4")
                    own = np.isin(heads, np.array(wanted, dtype=np.int64))
                    for head, at, low, high in zip(heads[own].tolist(), kept[own].tolist(), least[own].tolist(), most[own].tolist(), strict=True):
                        rows.append((head, None, doc, at, low, high, short[at : at + pick.length - low].tobytes(), short[at - high : at][::-1].tobytes()))
                    if common:
                        own = np.isin(heads, np.array(common, dtype=np.int64))
                        yield from runs(doc, words, kept[own], least[own], most[own])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "key long, key2 long, doc_id long, at int, least int, most int, suffix binary, before binary")


SPAN = "doc_id long, first int, last int, source long"


def spans_of_runs(runs: DataFrame, pick: Selection) -> DataFrame:
    """Spans of the hashed runs that a document with a smaller id has: doc_id, first, last, source."""
    low = checkpointed(runs.groupBy("key", "key2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"), F.count("*").alias("c")).where("source < high").drop("high"))
    top = low.orderBy(F.desc("c"), "key", "key2").limit(TOP + 1).toArrow()
    least = top.column("c")[TOP].as_py() if top.num_rows > TOP else 0
    top = top.filter(pa.compute.greater(top.column("c"), least)).sort_by("key")
    known = runs.sparkSession.sparkContext.broadcast(tuple(np.asarray(top.column(k)) for k in ("key", "key2", "source")))  # TOP rows at most

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, key2, source = known.value
        for batch in batches:
            h1, h2, doc, at = (np.asarray(batch.column(k)) for k in range(4))
            i = np.minimum(np.searchsorted(key, h1), max(0, len(key) - 1))
            if not len(key) or not (hit := (key[i] == h1) & (key2[i] == h2) & (source[i] < doc)).any():
                continue
            doc, at, low = doc[hit], at[hit], source[i[hit]]
            cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]) | (at[1:] - at[:-1] != 1)]))
            ends = np.append(cuts[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(at[cuts]), pa.array((at[ends] + pick.length).astype(np.int32)), pa.array(low[cuts])], names=["doc_id", "first", "last", "source"])

    found = runs.select("key", "key2", "doc_id", "at").mapInArrow(looked_up, SPAN)
    if not least:
        return found
    rest = runs.join(low.where(F.col("c") <= least).select("key", "key2", "source"), ["key", "key2"]).where("source < doc_id")
    return found.union(rest.select("doc_id", F.col("at").alias("first"), (F.col("at") + pick.length).cast("int").alias("last"), "source"))


def padded(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column.to_pylist()), dtype=">u4").reshape(-1, width).astype(np.uint32)


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows."""
    different = a != b
    return np.where(different.any(axis=1), different.argmax(axis=1), a.shape[1])


def matches(rows: pa.Table, pick: Selection) -> pa.RecordBatch | None:
    """Spans that earlier documents have, from suffixes sorted by key and content; complete keys only.

    For each number of words before, suffixes that agree in these and in as many words from
    their place on as make up the length are one group, and its earliest document the source.
    """
    c = {name: rows.column(name).combine_chunks() for name in rows.schema.names}
    key, doc, at, least, most = (np.asarray(c[k]) for k in ("key", "doc_id", "at", "least", "most"))
    suffix, before = padded(c["suffix"], pick.length), padded(c["before"], max(1, pick.left))
    n = len(key)
    common = np.where(key[1:] == key[:-1], same(suffix[1:], suffix[:-1]), -1)  # words shared by neighbours
    sources = np.full((n, pick.left + 1), np.iinfo(np.int64).max)
    agreed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for o in range(pick.left + 1):
            if o:
                agreed = mix(agreed * np.uint64(0x9E3779B97F4A7C15) + before[:, o - 1].astype(np.uint64), 3)
            alike = np.concatenate([[0], np.cumsum(common < pick.length - o)]).astype(np.uint64)
            members = np.flatnonzero((least <= o) & (o <= most))
            if len(members) < 2:
                continue
            group = mix(agreed[members] ^ mix(alike[members], 4), 5)
            order = np.argsort(group, kind="stable")
            members, group = members[order], group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            low = np.repeat(np.minimum.reduceat(doc[members], starts), np.diff(np.append(starts, len(members))))
            earlier = low < doc[members]
            sources[members[earlier], o] = low[earlier]
    flat = sources.ravel()
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    first[:: pick.left + 1] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(flat)) - 1
    found = flat[begin] != np.iinfo(np.int64).max
    if not found.any():
        return None
    begin, end = begin[found], end[found]
    row, before_last, before_first = begin // (pick.left + 1), begin % (pick.left + 1), end % (pick.left + 1)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((at[row] - before_first).astype(np.int32)), pa.array((at[row] - before_last + pick.length).astype(np.int32)), pa.array(flat[begin])], names=["doc_id", "first", "last", "source"])


SPANS = "array<struct<first:int,last:int,sources:array<bigint>>>"


def repeated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, spans: the documents with a passage of at least ``length`` words that is in one with a smaller doc_id.

    Words are runs of characters other than ASCII punctuation and space, A-Z lower-cased.
    ``spans`` are word ranges (from 0, end exclusive) with their sources: for each run of
    ``length`` words in them the smallest doc_id that has it (of a copy of a whole text, the
    smallest doc_id with that text). The document with the smallest doc_id keeps its passage,
    so just one is left of each. Texts that are null or have fewer words have none, and neither
    do repeats within one document.
    Rows that repeat a doc_id and text are one document; rows without a doc_id take no part.
    An empty table gives no row. Columns other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    pick = Selection(length)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows, at_rows = written(digests(base, pick).where(F.col("n") >= length), "digests")
    classes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    copies = checkpointed(rows.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "n", "rep").distinct())
    single, at_single = written(rows.join(copies.select("doc_id", "n"), ["doc_id", "n"], "left_anti").select("doc_id", "heads"), "digests")
    delete_path(spark, at_rows)
    heads = single.select("doc_id", F.inline("heads"))
    shared = checkpointed(heads.groupBy("head").agg(F.sum("times").alias("c"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("head", "c"))
    listed = lambda which: F.collect_set(F.when(which, F.col("head")))
    lists = checkpointed(heads.join(shared, "head").groupBy("doc_id").agg(listed(F.col("c") <= SHARE).alias("wanted"), listed(F.col("c") > SHARE).alias("common")))
    delete_path(spark, at_single)
    kept = suffixes(base.join(lists, "doc_id").select("doc_id", "text", "wanted", "common"), pick)
    if very := not lists.where("size(common) > 0").isEmpty():
        kept = checkpointed(kept)
    runs, kept = kept.where("suffix is null"), kept.where("suffix is not null").drop("key2")
    dealt = kept.repartition(partitions(spark, documents), "key").sortWithinPartitions("key", "suffix", "doc_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK_ROWS:
                continue
            whole = pa.Table.from_batches(held)
            keys = np.asarray(whole.column("key").combine_chunks())
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                if (found := matches(whole.slice(0, cut), pick)) is not None:
                    yield found
                held, size = whole.slice(cut).to_batches(), whole.num_rows - cut
        if held and (found := matches(pa.Table.from_batches(held), pick)) is not None:
            yield found

    spans = dealt.mapInArrow(run, SPAN)
    whole = copies.select("doc_id", F.lit(0).alias("first"), F.col("n").alias("last"), F.col("rep").alias("source"))
    if very:
        spans = spans.union(spans_of_runs(runs, pick))
    every = spans.union(whole).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "source")).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans_ in batch.column(1).to_pylist():
                ranges = merged([(s["first"], s["last"]) for s in spans_])
                sources: list[set[int]] = [set() for _ in ranges]
                starts = np.array([a for a, _ in ranges])
                for s in spans_:
                    sources[int(np.searchsorted(starts, s["first"], side="right")) - 1].add(s["source"])
                out.append([{"first": a, "last": b, "sources": sorted(x)} for (a, b), x in zip(ranges, sources, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("sources", pa.list_(pa.int64()))])))], names=["doc_id", "spans"])

    return every.mapInArrow(joined, f"doc_id long, spans {SPANS}")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some ranges of its words, up to the word that follows each."""
    at = [m.start() for m in WORD.finditer(text)]
    at.append(len(text))
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a]])
        done = at[b]
    out.append(text[done:])
    return "".join(out).strip()


def cut(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents (all their columns) without passages that an earlier document has.

    Rows of which no word is left are dropped; all others stay, and those without such a
    passage stay as they are. A column n_chars follows the new text.
    """
    spans = repeated(documents, length).select(F.col("doc_id").alias("_doc"), F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))).alias("_spans"))
    columns = documents.columns
    rows = documents.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"))  # the text once, as all of it is shuffled
    both = rows.join(spans, "_doc", "left").select("row", F.when(F.col("_spans").isNotNull(), F.col("row.text").cast("string")).alias("_text"), "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left = without(text, [(s["first"], s["last"]) for s in spans_]) if spans_ else None
                new.append(left)
                keep.append(left is None or WORD.search(left) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "new"]).filter(pa.array(keep))

    done = both.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, new string")
    put = {"text": F.coalesce("new", "row.text")} | ({"n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in columns else {})
    return done.select(*[put.get(c, F.col("row")[c]).alias(c) for c in columns])
