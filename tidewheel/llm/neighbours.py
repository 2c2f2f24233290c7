"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

Nearness is the largest inner product. A vector gets one more coordinate, sqrt(M^2 - |v|^2)
with M the largest norm, which makes all norms equal, so k-means cells suit inner products.
The tree is fitted on at most ``sample`` vectors (chosen by hash); every vector is then put
into its leaf. A query takes leaves from a priority queue, best first. How many it takes is
calibrated: the neighbours of ``probes`` queries are found by comparing them with every
vector, and the leaf visits are widened until the queue reaches ``recall`` of them. Data
without structure needs most of the leaves, up to all of them, which is then exact.

Leaves are dealt out in groups of neighbouring leaves, which the vectors of one task make up
(a large leaf is several groups); a query goes once to each group that holds leaves it visits.
So a vector is sent once for each ``Q_BLOCK`` queries of its group, a query once for each
group, and what a task holds is bounded.

Equal vectors are searched once as a class; its 21 smallest vec_ids stand for it, which is
enough for any answer of 20, so a vector that a third of the rows share costs one vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, groups, partitions

SAMPLE, PROBES, RECALL = 65_536, 200, 0.97
BRANCH, LEAF_ROWS, LEAST_SAMPLE, ROUNDS = 8, 1024, 16, 10
#: Vectors and queries that meet in one task: 16 MB of each at 64 components.
X_BLOCK, Q_BLOCK = 32_768, 32_768


class Tree:
    """Centroids and children of every node; leaves are numbered in ``leaf``."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 3):
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, max(1, leaf_size), rng)
        self.centres = np.array(self.centre)

    def _grow(self, x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> int:
        node = len(self.centre)
        self.centre.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x, rng) if len(x) > leaf_size else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        for part in parts:
            self.children[node].append(self._grow(part, leaf_size, rng))
        return node

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        k = min(BRANCH, len(x))
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            own = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
            centres = np.array([x[own == i].mean(axis=0) if (own == i).any() else x[rng.integers(len(x))] for i in range(k)])
        return [x[own == i] for i in range(k) if (own == i).any()]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going to the nearest child at every node."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            below = np.array(self.children[node])
            centres = self.centres[below]
            own = np.argmin((centres**2).sum(axis=1) - 2 * x[rows] @ centres.T, axis=1)
            todo += [(int(below[i]), rows[own == i]) for i in range(len(below)) if (own == i).any()]
        return out

    def visits(self, q: np.ndarray, counts: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves from the priority queue, until there are ``leaves`` of them that hold ``rows`` vectors."""
        near = self.centres @ q
        queue, out, held = [(-near[0], 0)], [], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                held += int(counts[self.leaf[node]])
            for child in self.children[node]:
                heapq.heappush(queue, (-near[child], child))
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))[:, None]])


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (doubles): what takes part, one row per vec_id."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(good).groupBy("vec_id").agg(F.min("v").alias("v"))


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, k: int = 20, is_query: str = "vec_id % 20 = 0", id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, probes: int = PROBES, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` picks.

    Scores are inner products of the original vectors in doubles; ties go to the smaller
    vec_id. Null, empty and zero vectors, and those with a null or non-finite component or of
    another length than the most common (the longer one, on a tie), take no part, nor do
    rows without a vec_id. Of rows with one vec_id the one with the smallest vector counts.
    An empty table gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = checkpointed(clean(vectors, id_column, vector_column))
    usual = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if usual is None:
        return spark.createDataFrame([], RESULT)
    width = usual["w"]
    rows = rows.where(F.size("v") == width).withColumn("h", F.xxhash64("v"))
    classes = checkpointed(rows.groupBy("h", "v").agg(F.min("vec_id").alias("rep")))
    mapped = checkpointed(rows.join(classes, ["h", "v"]).select("vec_id", "rep"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, most = classes.agg(F.count("*"), F.max(norm)).first()
    queries = mapped.where(is_query).select(F.col("vec_id").alias("query_id"), "rep")
    asked = checkpointed(queries.select("rep").distinct().join(classes, "rep").select("rep", "v"))

    fit = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(lifted(matrix(fit, width), most), max(LEAST_SAMPLE, leaf_rows * min(sample, total) // total))
    shared = spark.sparkContext.broadcast(tree)
    leaves = tree.leaves

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.place(lifted(matrix(b.column(1), width), most)), pa.int32())], names=["rep", "v", "leaf"])

    indexed = checkpointed(classes.select("rep", "v").mapInArrow(placed, "rep long, v array<double>, leaf int"))
    counts = np.zeros(leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    widest = calibrated(tree, asked, indexed, counts, width, k, probes, recall)

    group, parts = grouped(counts, min(X_BLOCK, max(leaf_rows, int(total) // (4 * partitions(spark)))))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = np.hstack([matrix(b.column(1), width), np.zeros((b.num_rows, 1))])
            of, groups_, leaves_ = [], [], []
            for i, x in enumerate(q):
                by_group: dict[int, list[int]] = {}
                for leaf in shared.value.visits(x, counts, widest, k + 1):
                    by_group.setdefault(int(group[leaf]), []).append(leaf)
                of += [i] * len(by_group)
                groups_ += by_group
                leaves_ += by_group.values()
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(groups_, pa.int32()), pa.array(leaves_, pa.list_(pa.int32()))], names=["rep", "v", "group", "leaves"])

    visits = checkpointed(asked.mapInArrow(visiting, "rep long, v array<double>, group int, leaves array<int>"))
    wanted = visits.groupBy("group").count().collect()
    plan = F.broadcast(spark.createDataFrame([(r["group"], int(parts[r["group"]]), -(-r["count"] // Q_BLOCK)) for r in wanted], "group int, nx long, nq long"))  # a row for each group of leaves at most
    of_leaf = F.broadcast(spark.createDataFrame([(leaf, int(g)) for leaf, g in enumerate(group)], "leaf int, group int"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.xxhash64("group", "xb", "qb").alias("block")
    xs = indexed.join(of_leaf, "leaf").join(plan, "group").withColumn("xb", F.pmod(F.xxhash64("rep", F.lit(1)), "nx")).withColumn("qb", span("nq")).select(block, F.lit(0).alias("asks"), "rep", "v", F.array("leaf").alias("leaves"))
    qs = visits.join(plan, "group").withColumn("qb", F.pmod(F.xxhash64("rep", F.lit(2)), "nq")).withColumn("xb", span("nx")).select(block, F.lit(1).alias("asks"), "rep", "v", "leaves")
    dealt = xs.union(qs).repartition(partitions(spark), "block").sortWithinPartitions("block", "asks")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "block"):
            g = g.combine_chunks()
            asks = np.asarray(g.column("asks").combine_chunks()) == 1
            if asks.all() or not asks.any():
                continue
            ids, v, leaves_ = np.asarray(g.column("rep").combine_chunks()), matrix(g.column("v").combine_chunks(), width), g.column("leaves").combine_chunks()
            own = np.asarray(leaves_.filter(pa.array(~asks)).flatten())
            yield best(ids[asks], v[asks], leaves_.filter(pa.array(asks)).to_pylist(), ids[~asks], v[~asks], own, k + 1)

    near = "array<struct<score:double,low:bigint>>"
    partial = dealt.mapInArrow(compared, f"query long, near {near}")
    merged = partial.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, k + 1).alias("near"))
    few = mapped.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("n") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("ids"))
    hits = merged.select("query", F.explode("near").alias("hit")).select("query", (-F.col("hit.low")).alias("rep"), F.col("hit.score").alias("score"))
    wide = hits.join(few, "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    ordered = wide.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("found"))
    own = queries.join(ordered, queries["rep"] == ordered["query"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))


def grouped(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each leaf, and into how many parts the vectors of each group are cut; groups are leaves in a row with ``size`` vectors at most, or one leaf."""
    group, parts, held = np.zeros(len(counts), dtype=np.int32), [], 0
    for leaf, n in enumerate(counts.tolist()):
        if not parts or held + n > size:
            parts.append(1)
            held = 0
        group[leaf] = len(parts) - 1
        held += n
        parts[-1] = max(1, -(-held // size))
    return group, np.array(parts, dtype=np.int64)


def best(query_ids: np.ndarray, queries: np.ndarray, visited: list[list[int]], ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query in the leaves it visits; ids are given negated, so that larger means earlier in both fields."""
    near = []
    kinds, own = np.unique(leaves, return_inverse=True)
    step = max(1, min(256, (1 << 22) // max(1, len(ids))))
    for a in range(0, len(query_ids), step):
        scores = queries[a : a + step] @ vectors.T
        for row, asked in zip(scores, visited[a : a + step], strict=True):
            here = np.isin(kinds, asked)
            at = np.arange(len(row)) if here.all() else np.flatnonzero(here[own])
            got = row[at]
            top = np.flatnonzero(got >= np.partition(got, len(got) - k)[len(got) - k]) if len(got) > k else np.arange(len(got))
            top = top[np.lexsort((ids[at[top]], -got[top]))][:k]
            near.append([{"score": s, "low": -i} for s, i in zip(got[top].tolist(), ids[at[top]].tolist(), strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(near, pa.list_(pa.struct([("score", pa.float64()), ("low", pa.int64())])))], names=["query", "near"])


def calibrated(tree: Tree, asked: DataFrame, indexed: DataFrame, counts: np.ndarray, width: int, k: int, probes: int, recall: float) -> int:
    """Leaf visits that reach ``recall`` of the true neighbours of at most ``probes`` queries, compared with all vectors."""
    chosen = asked.orderBy(F.xxhash64("rep", F.lit(9)), "rep").limit(probes).toArrow()
    if not chosen.num_rows:
        return 1
    q_ids, q = np.asarray(chosen.column("rep").combine_chunks()), matrix(chosen.column("v").combine_chunks(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = q @ matrix(b.column(1), width).T
                n = min(k + 1, scores.shape[1])
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                leaf = np.asarray(b.column(2))[top]
                rows = np.repeat(np.arange(len(q)), n)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.asarray(b.column(0))[top].ravel()), pa.array(np.take_along_axis(scores, top, axis=1).ravel()), pa.array(leaf.ravel(), pa.int32())], names=["probe", "rep", "score", "leaf"])

    scored = indexed.mapInArrow(run, "probe int, rep long, score double, leaf int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rep"))
    truth = scored.withColumn("n", rank).where(F.col("n") <= k + 1).select("probe", "rep", "leaf").collect()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(np.append(x, 0.0), counts, tree.leaves, 0))} for x in q]
    reached = np.array([order[r["probe"]][r["leaf"]] for r in truth if r["rep"] != q_ids[r["probe"]]])
    visits = 1
    while visits < tree.leaves and len(reached) and (reached < visits).mean() < recall:
        visits += 1
    return visits
