"""Near-duplicate documents by SuperMinHash, banding, exact verification and union by components.

1. Every document's shingle set is hashed, fingerprinted and signed. Equal sets are one class
   from here on, named by its smallest doc_id, so copies cost nothing further.
2. Signatures are cut into bands; classes that share a band value meet in a bucket. In each
   bucket the smallest class is compared with all others on the full sets (a star: as many
   comparisons as members, not their square).
3. Members of less than 30 % similarity with their bucket's leader are compared, block by
   block on the full sets, with all members of less than 50 %. By the triangle inequality
   (for 1 - similarity) they can have no link of 80 % with any other member.
4. Components of the links found so far that an edge of at least 30 % similarity joins are a
   family. Members outside a family's largest component are compared with the whole family,
   block by block on the full sets, so no link inside it is missed.
5. Components are the union of all links. So any two classes that share a bucket are linked
   if they are 80 % alike, whatever else is in the bucket.

A pair at exactly the threshold of 0.8 shares one of the 50 bands of 6 with probability
1 - (1 - 0.8^6)^50 > 0.9999997; more alike pairs are surer still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, checkpointed, groups, mix, partitions, shingle_hashes, slices, space_words
from .graph import components, relabelled

BANDS, ROWS, PERCENT, FAMILY_PERCENT = 50, 6, 80, 30
#: A member this like its leader has no link with one below FAMILY_PERCENT.
NEAR_PERCENT = FAMILY_PERCENT + 100 - PERCENT
X_BLOCK, F_BLOCK, F_SHINGLES = 256, 512, 400_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Levels for which swaps are traced back; beyond them each element's permutation is held.
TRACED = 4
WORDS = {"space": space_words, "alnum": alnum_words}


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values for each non-empty set of 64-bit hashes.

    Each element has a random permutation of the m slots (Fisher-Yates, driven by its hash);
    at level j it offers the value (j, random) to slot j of its permutation, and a slot keeps
    the smallest offer. All elements go through a level together. A set stops at the level
    that fills its last slot, as later offers are larger than every value it has.
    """
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * m, FULL, dtype=np.uint64)
    swaps: list[np.ndarray] = []
    state = None
    for j in range(m):
        z = mix(x, j + 1)
        k = (np.uint64(j) + (((z >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int64)
        if j < TRACED:
            slot = k.copy()
            for i in range(j - 1, -1, -1):
                slot[slot == swaps[i]] = i
            swaps.append(k)
        else:
            rows = np.arange(len(x))
            if state is None:
                state = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                for i, s in enumerate(swaps):
                    state[rows, s], state[rows, i] = state[rows, i].copy(), state[rows, s].copy()
            slot = state[rows, k].astype(np.int64)
            state[rows, k] = state[rows, j]
        at = doc * m + slot
        open_ = np.flatnonzero(out[at] == FULL)
        np.minimum.at(out, at[open_], (np.uint64(j) << np.uint64(32)) | (z[open_] & np.uint64(0xFFFFFFFF)))
        unfilled = (out.reshape(-1, m) == FULL).any(axis=1)
        if not unfilled.any():
            break
        stay = unfilled[doc]
        if not stay.all():
            x, doc = x[stay], doc[stay]
            swaps = [s[stay] for s in swaps]
            state = state[stay] if state is not None else None
    return out.reshape(-1, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 77), (len(signatures), bands))
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r], r)
    return h.view(np.int64)


def signed(documents: DataFrame, shingle: int, words: str, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band values."""
    cut = WORDS[words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch, limit=1 << 20):
                sets = [shingle_hashes(hashes.of(cut(t or b"")), shingle) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                values: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_hashes(super_minhash([sets[i] for i in full], bands * rows), bands, rows), strict=True):
                        values[i] = row
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64) for s in sets]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<bigint>")


def shingle_sets(documents: DataFrame, shingle: int, words: str) -> DataFrame:
    cut = WORDS[words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in slices(batch):
                sets = [shingle_hashes(hashes.of(cut(t or b"")), shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return documents.mapInArrow(run, "doc_id long, shingles binary")


def join(root: dict[int, int], a: int, b: int) -> bool:
    """Joins the sets of a and b; False if they are one already."""
    ends = []
    for x in (a, b):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        ends.append(x)
    root[ends[0]] = ends[1]
    return ends[0] != ends[1]


def verified(blocks: DataFrame, sets: DataFrame, percent: int, one_per_label: bool, parts: int) -> DataFrame:
    """Compares the x rows of each block with its other rows on the full sets: a, b, linked, near.

    blocks: block, x (boolean), doc_id, label. Rows with one label are not compared. With
    ``one_per_label`` a block gives no pair of labels that its other pairs join already, which
    is enough for components.
    """
    rows = blocks.join(sets, "doc_id").repartition(parts, "block").sortWithinPartitions("block", F.col("x").desc()).select("block", "x", "doc_id", "label", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int, bool, bool]] = []

        def flush() -> pa.RecordBatch:
            a, b, linked, near = zip(*pairs, strict=True)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_())], names=["a", "b", "linked", "near"])

        for block in groups(batches, "block"):
            is_x = np.asarray(block.column("x").combine_chunks())
            ids, labels = np.asarray(block.column("doc_id").combine_chunks()), np.asarray(block.column("label").combine_chunks())
            sets_ = [np.frombuffer(s, dtype=np.uint64) for s in block.column("shingles").to_pylist()]
            others = [i for i in np.flatnonzero(~is_x) if len(sets_[i])]
            if not others:
                continue
            flat = np.concatenate([sets_[i] for i in others])
            sizes = np.array([len(sets_[i]) for i in others])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            other_ids, other_labels = ids[others], labels[others]
            root: dict[int, int] = {}
            for i in np.flatnonzero(is_x):
                own = sets_[i]
                if not len(own):
                    continue
                inside = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(inside.astype(np.int64), starts)
                union = len(own) + sizes - both
                for k in np.flatnonzero((100 * both >= percent * union) & (other_labels != labels[i]) & (other_ids != ids[i])):
                    if one_per_label and not join(root, int(labels[i]), int(other_labels[k])):
                        continue
                    pairs.append((int(ids[i]), int(other_ids[k]), bool(100 * both[k] >= PERCENT * union[k]), bool(100 * both[k] >= NEAR_PERCENT * union[k])))
            if len(pairs) > 20_000:
                yield flush()
        if pairs:
            yield flush()

    return rows.mapInArrow(run, "a long, b long, linked boolean, near boolean")


def blocks_of_stars(stars: DataFrame) -> DataFrame:
    """A leader with blocks of its members; a leader of many is repeated in several blocks."""
    sized = checkpointed(stars.groupBy("leader").agg(F.ceil(F.count("*") / F_BLOCK).alias("n")))  # so that the join below can be split at a leader of many
    members = stars.join(sized, "leader").select(F.xxhash64("leader", F.pmod(F.xxhash64("rep"), "n")).alias("block"), F.lit(False).alias("x"), F.col("rep").alias("doc_id"))
    leaders = sized.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select(F.xxhash64("leader", "k").alias("block"), F.lit(True).alias("x"), F.col("leader").alias("doc_id"))
    return leaders.union(members).withColumn("label", F.col("doc_id"))


def blocks_of_families(nodes: DataFrame) -> DataFrame:
    """nodes: doc_id, family, label, n. What is outside a family's largest component, against the whole family."""
    counts = nodes.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    plan = counts.groupBy("family").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.sum("s").alias("size")).where("most < all")
    plan = plan.select("family", "main", F.ceil((F.col("all") - F.col("most")) / X_BLOCK).alias("nx"), F.greatest(F.ceil(F.col("all") / F_BLOCK), F.ceil(F.col("size") / F_SHINGLES)).alias("nf"))
    rows = nodes.join(plan, "family").select(F.col("family").alias("set"), "doc_id", "label", (F.col("label") != F.col("main")).alias("x"), "nx", "nf")
    return crossed(rows)


def blocks_of_leftovers(left: DataFrame) -> DataFrame:
    """left: key, doc_id, label, n, x. What is unlike a bucket's leader (x), against all that is not near it; buckets of the same rows count once."""
    mark = lambda seed: F.bit_xor(F.xxhash64("doc_id", "x", F.lit(seed)))
    plan = left.groupBy("key").agg(F.count("*").alias("all"), F.sum(F.col("x").cast("long")).alias("xs"), F.sum("n").alias("size"), mark(1).alias("m1"), mark(2).alias("m2")).where("xs > 0 and all > 1")
    plan = plan.groupBy("m1", "m2", "all", "xs", "size").agg(F.min("key").alias("key"))
    plan = plan.select("key", F.ceil(F.col("xs") / X_BLOCK).alias("nx"), F.greatest(F.ceil(F.col("all") / F_BLOCK), F.ceil(F.col("size") / F_SHINGLES)).alias("nf"))
    return crossed(left.join(plan, "key").select(F.col("key").alias("set"), "doc_id", "label", "x", "nx", "nf"))


def crossed(rows: DataFrame) -> DataFrame:
    """rows: set, doc_id, label, x, nx, nf. The x rows of a set in nx parts, each with every one of nf parts of all its rows."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    xs = rows.where("x").withColumn("xb", F.pmod(F.xxhash64("doc_id", F.lit(1)), "nx")).withColumn("fb", span("nf")).withColumn("x", F.lit(True))
    fs = rows.withColumn("fb", F.pmod(F.xxhash64("doc_id", F.lit(2)), "nf")).withColumn("xb", span("nx")).withColumn("x", F.lit(False))
    pick = [F.xxhash64("set", "xb", "fb").alias("block"), "x", "doc_id", "label"]
    return xs.select(*pick).union(fs.select(*pick))


def near_duplicates(documents: DataFrame, shingle: int = 5, words: str = "space", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``.

    Documents are linked when their shingle sets have a Jaccard similarity of at least 0.8.
    A text shorter than a shingle is one shingle; a null or empty one has none, is linked with
    nothing and is its own component. Rows with one doc_id are one document as to links. A
    row with a null doc_id is linked with nothing, has a null component and is kept. An empty
    table gives no row. Columns other than doc_id and text are not read.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions(base.sparkSession, base)
    rows_ = checkpointed(signed(base, shingle, words, bands, rows))
    full = rows_.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    members = checkpointed(full.select("doc_id", "fp1", "fp2").join(classes.where("rep < last"), ["fp1", "fp2"]).where("doc_id <> rep").select("doc_id", "rep", "fp1", "fp2").distinct())
    several = full.select("doc_id", "fp1", "fp2").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")  # ids with different texts
    buckets = checkpointed(full.join(members, ["doc_id", "fp1", "fp2"], "left_anti").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")))
    led = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    met = checkpointed(buckets.join(led, "key").where("rep <> leader").select("key", "leader", "rep"))
    stars = checkpointed(met.select("leader", "rep").distinct())
    wanted = stars.select(F.col("leader").alias("doc_id")).union(stars.select("rep")).distinct()
    sets = checkpointed(shingle_sets(base.join(wanted, "doc_id", "left_semi"), shingle, words))
    sizes = sets.select("doc_id", F.expr("octet_length(shingles) div 8").alias("n"))
    edges = checkpointed(verified(blocks_of_stars(stars), sets, FAMILY_PERCENT, False, parts))
    tied = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.where("linked").select("a", "b").union(tied))

    found = edges.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "near")
    far = stars.join(found.where("near"), ["leader", "rep"], "left_anti").join(found, ["leader", "rep"], "left").select("leader", "rep", F.col("near").isNull().alias("x"))
    labelled = lambda nodes: relabelled(nodes.withColumn("label", F.col("doc_id")), "label", labels)
    left = labelled(met.join(far, ["leader", "rep"]).select("key", F.col("rep").alias("doc_id"), "x")).join(sizes, "doc_id").select("key", "doc_id", "label", "n", "x")
    edges = edges.union(verified(blocks_of_leftovers(checkpointed(left)), sets, PERCENT, True, parts))

    ends = relabelled(relabelled(edges.select("a", "b", "linked"), "a", labels), "b", labels).where("a <> b")
    across = checkpointed(ends.groupBy("a", "b").agg(F.max("linked").alias("linked")))
    if not across.isEmpty():
        families = components(across.select("a", "b"))
        families = families.union(families.select("component", "component").distinct())
        nodes = labelled(sizes).join(families.select(F.col("node").alias("label"), F.col("component").alias("family")), "label")
        nodes = checkpointed(relabelled(nodes, "label", components(across.where("linked").select("a", "b"))))
        more = verified(blocks_of_families(nodes), sets, PERCENT, True, parts).select("a", "b")
        last = components(across.where("linked").select("a", "b").union(relabelled(relabelled(more, "a", labels), "b", labels)))
        labels = checkpointed(relabelled(labels, "component", last).unionByName(last))
    copies = relabelled(members.select("doc_id", F.col("rep").alias("component")), "component", labels)
    found = copies.union(labels.select("node", "component")).groupBy("doc_id").agg(F.min("component").alias("_component"))
    return rows_.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.coalesce("_component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(documents: DataFrame, shingle: int = 5, words: str = "space") -> DataFrame:
    """The documents (all their columns) that are kept; rows that repeat a doc_id and text are one.

    Rows of one doc_id with different texts stay or go together. A null text is a text of its
    own here. Rows without a doc_id stay, each text once.
    """
    found = near_duplicates(documents, shingle, words).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("h1"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("h2"))
    left = rows.join(found, F.col("_id") == F.col("_dropped"), "left_anti")
    return left.dropDuplicates(["_id", "h1", "h2"]).select("row.*")
