"""The order, admission and times of calls of many pools at once, as one job over a table.

All of these describe calls that are submitted up front, in a given order. A pool is a
sequence by nature, so one task has all of a pool; what it holds of it is bounded by the
pool's workers and waiting calls, not by its rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queues import make_queue


def pooled(df: DataFrame, *columns: Column, **more: Column) -> DataFrame:
    """Rows of a pool in one task, sorted by ``columns`` after the pool."""
    rows = df.select(*columns, *[c.alias(k) for k, c in more.items()])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "pool").sortWithinPartitions(*rows.columns)


def through_queue(df: DataFrame, pool: str, order: str, strategy: str = "fifo", priority: Column | None = None, workers: int = 1, max_waiting: int = 100) -> DataFrame:
    """pool, call, state (running, queued or rejected), run_order (null if rejected): a burst of calls for each pool.

    The first ``workers`` calls run at once; the queue, one of ``make_queue``, takes the next
    ``max_waiting`` and gives them back in its order. ``priority`` is a column of numbers. A
    null pool is a pool; a null order comes first.
    """
    rows = pooled(df, F.col(pool).cast("long").alias("pool"), F.col(order).cast("long").alias("call"), priority=(F.lit(None) if priority is None else priority).cast("double"))
    kinds = {"pool": pa.int64(), "call": pa.int64(), "state": pa.string(), "run_order": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, queue = object(), 0, make_queue(strategy)
        out: list[tuple] = []

        def drained() -> None:
            n = started
            while (task := queue.pop()) is not None:
                n += 1
                out.append((current, task.call, "queued", n))

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
            out.clear()
            return batch

        for batch in batches:
            for name, call, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != current:
                    drained()
                    current, started = name, 0
                if started < workers:
                    started += 1
                    out.append((name, call, "running", started))
                elif queue.size() < max_waiting:
                    queue.push(SimpleNamespace(call=call, metadata=None if rank is None else {"priority": rank}))
                else:
                    out.append((name, call, "rejected", None))
            if out:
                yield made()
        drained()
        if out:
            yield made()

    return rows.mapInArrow(run, "pool long, call long, state string, run_order long")


def on_workers(df: DataFrame, pool: str, order: str, duration: str | Column, workers: int, limit: float | None = None) -> DataFrame:
    """pool, order, worker, start, finish, timed_out: each call goes to the worker of its pool that is free first.

    With ``limit`` a call is stopped when it has run so long, counted from its start. A null
    duration counts as 0. One time for each worker is held.
    """
    rows = pooled(df, F.col(pool).cast("long").alias("pool"), F.col(order).cast("long").alias("call"), duration=F.coalesce((F.col(duration) if isinstance(duration, str) else duration).cast("double"), F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = object(), []
        for batch in batches:
            out = []
            for name, call, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != current:
                    current, free = name, [(0.0, w) for w in range(workers)]
                start, worker = heapq.heappop(free)
                late = limit is not None and want > limit
                finish = start + (limit if late else want)
                heapq.heappush(free, (finish, worker))
                out.append((name, call, worker, start, finish, late))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pool", "call", "worker", "start", "finish", "timed_out"])

    return rows.mapInArrow(run, "pool long, call long, worker int, start double, finish double, timed_out boolean")
