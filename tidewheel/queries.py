"""The offload operators as queries over the tables of a folder, and SQL that gives the same rows."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import Registry, worker
from .operators.events import event_rows
from .operators.gather import gather, with_sequence
from .operators.offload import call, call_safe, emit
from .plans.pool import pool
from .plans.schedule import on_workers, through_queue
from .sources.tables import table

WORKERS, WAITING = 4, 40


def net(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


def multiply(a: pd.Series, b: pd.Series) -> pd.Series:
    return a * b


def fibonacci(n: int) -> int:
    a, b = 0, 1
    for _ in range(n):
        a, b = b, a + b
    return a


def picky(kind: str, value: float) -> float:
    if kind == "error":
        error = ValueError(f"Test error {kind}")
        error.kind = kind
        raise error
    return value


def halved(value: float | None) -> float | None:
    return None if value is None else value / 2


def reports(kind: str, value: float) -> str:
    emit({"kind": kind})
    return kind.upper()


def prints(kind: str, number: int) -> str:
    print(f"stdout {kind}")
    print(f"stderr {number}", file=sys.stderr)
    return "done"


def prefix_bytes(text: str | None) -> bytes | None:
    return None if text is None else text.encode()


def registry(spark: SparkSession) -> Registry:
    return worker(spark, {"net": (net, "double", True), "multiply": (multiply, "double", True), "fibonacci": (fibonacci, "long"), "halved": (halved, "double")})


def offload_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function by value over two columns."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", call(net, "l_extendedprice", "l_discount", returns="double", vectorised=True).alias("net"))


def offload_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function by its name, in SQL."""
    registry(spark)
    return spark.sql("SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS net FROM {lines}", lines=table(spark, sf_dir, "lineitem"))


def proxy_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", registry(spark).proxy().multiply("l_quantity", "l_extendedprice").alias("product"))


def methods_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark).methods_frame()


def gather_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the order of submission."""
    events = with_sequence(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return gather(events.select("seq", "event_id", call(halved, "value", returns="double").alias("half")))


def queue_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a burst of calls on one worker, through the queue itself."""
    return through_queue(table(spark, sf_dir, "events"), "user_id", "event_id", "fifo", max_waiting=WAITING)


def queue_lifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_queue(table(spark, sf_dir, "events"), "user_id", "event_id", "lifo", max_waiting=WAITING)


def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, by the number that their priority begins with; 5 is none, which is the queue's own default."""
    number = F.substring("o_orderpriority", 1, 1).cast("double")
    return through_queue(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "priority", F.when(number < 5, number), max_waiting=WAITING)


def queue_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each call where four run and a few may wait."""
    return through_queue(table(spark, sf_dir, "events"), "user_id", "event_id", "fifo", workers=WORKERS, max_waiting=WAITING).select("pool", "call", "state")


def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exception stays with its row, with its own properties."""
    done = table(spark, sf_dir, "events").select("event_id", call_safe(picky, "event_type", "value", returns="double", stack=False).alias("e"))
    return done.select("event_id", "e.value", F.col("e.error.name").alias("name"), F.col("e.error.message").alias("message"), F.col("e.error.details").alias("details"))


def null_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", call(halved, value, returns="double").alias("half"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").select("event_id", call_safe(reports, "event_type", "value", returns="string").alias("e"))
    return event_rows(done, "e", ["event_id"])


def std_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").select("event_id", call_safe(prints, "event_type", "user_id", returns="string", capture=True).alias("e"))
    return done.select("event_id", "e.stdout", "e.stderr", F.col("e.value").alias("result"))


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a pool that has been given a call for each nation, all of which wait for one another."""
    gate = threading.Event()
    with pool(spark, max_workers=WORKERS, max_queue_size=WAITING) as p:
        for _ in range(table(spark, sf_dir, "nation").count()):
            p.submit(lambda s: gate.wait(60))
        counters = p.stats()
        gate.set()
    return spark.createDataFrame([counters], ", ".join(f"{k} long" for k in counters))


def cents(value: str) -> Column:
    """Whole numbers, of which sums are exact in any order."""
    return F.floor(F.col(value) * 100).cast("double")


def schedule_k_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as calls on four workers, as long as their value."""
    return on_workers(table(spark, sf_dir, "events"), "user_id", "event_id", cents("value"), WORKERS)


def timeout_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worker for each user, and a deadline of 5000 from a call's start."""
    return on_workers(table(spark, sf_dir, "events"), "user_id", "event_id", cents("value"), 1, limit=5000.0)


def fibonacci_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_custkey") % 15).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), call(fibonacci, n, returns="long").alias("fib"))


def binary_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select("c_custkey", call(prefix_bytes, "c_name", returns="binary").alias("b"))
    return made.select("c_custkey", F.octet_length("b").cast("long").alias("n_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "offload_add": offload_add,
    "offload_named": offload_named,
    "proxy_multiply": proxy_multiply,
    "methods_list": methods_list,
    "gather_ordered": gather_ordered,
    "queue_fifo": queue_fifo,
    "queue_lifo": queue_lifo,
    "queue_priority": queue_priority,
    "queue_bounded": queue_bounded,
    "error_envelope": error_envelope,
    "null_params": null_params,
    "events_stream": events_stream,
    "std_capture": std_capture,
    "pool_stats": pool_stats,
    "schedule_k_workers": schedule_k_workers,
    "timeout_policy": timeout_policy,
    "fibonacci": fibonacci_calls,
    "binary_len": binary_len,
}

_NET = "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"
_POOLS = "SELECT user_id AS pool, event_id AS call, floor(value * 100) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events"
_SEQ = "SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq, count(*) OVER () AS total, value FROM events"

ORACLE: dict[str, str] = {
    "offload_add": _NET,
    "offload_named": _NET,
    "proxy_multiply": "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS product FROM lineitem",
    "methods_list": "SELECT * FROM (VALUES ('fibonacci'), ('halved'), ('methods'), ('multiply'), ('net'), ('run')) t(method)",
    "gather_ordered": f"SELECT seq, event_id, value / 2 AS half FROM ({_SEQ})",
    "queue_fifo": f"""
SELECT pool, call, CASE WHEN seq = 1 THEN 'running' WHEN seq <= {WAITING + 1} THEN 'queued' ELSE 'rejected' END AS state, CASE WHEN seq <= {WAITING + 1} THEN seq END AS run_order
FROM ({_POOLS})""",
    "queue_lifo": f"""
SELECT pool, call, CASE WHEN seq = 1 THEN 'running' WHEN seq <= {WAITING + 1} THEN 'queued' ELSE 'rejected' END AS state,
  CASE WHEN seq = 1 THEN 1 WHEN seq <= {WAITING + 1} THEN least(total, {WAITING + 1}) + 2 - seq END AS run_order
FROM ({_POOLS})""",
    "queue_priority": f"""
SELECT pool, call, CASE WHEN seq = 1 THEN 'running' WHEN seq <= {WAITING + 1} THEN 'queued' ELSE 'rejected' END AS state,
  CASE WHEN seq <= {WAITING + 1} THEN row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN seq = 1 THEN 0 WHEN seq <= {WAITING + 1} THEN 1 ELSE 2 END, p, seq) END AS run_order
FROM (
  SELECT o_custkey AS pool, o_orderkey AS call, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders)""",
    "queue_bounded": f"""
SELECT pool, call, CASE WHEN seq <= {WORKERS} THEN 'running' WHEN seq <= {WORKERS + WAITING} THEN 'queued' ELSE 'rejected' END AS state FROM ({_POOLS})""",
    "error_envelope": """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type = 'error' THEN 'ValueError' END AS name,
  CASE WHEN event_type = 'error' THEN 'Test error error' END AS message, CASE WHEN event_type = 'error' THEN '{"kind": "error"}' END AS details FROM events""",
    "null_params": "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value / 2 END AS half FROM events",
    "events_stream": """
SELECT event_id, 'event' AS kind, '{"kind": "' || event_type || '"}' AS payload FROM events
UNION ALL SELECT event_id, 'result', '{"value":"' || upper(event_type) || '"}' FROM events""",
    "std_capture": "SELECT event_id, 'stdout ' || event_type || chr(10) AS stdout, 'stderr ' || user_id || chr(10) AS stderr, 'done' AS result FROM events",
    "pool_stats": f"""
SELECT least(count(*), {WORKERS}) AS total_workers, least(count(*), {WORKERS}) AS busy_workers, CAST(0 AS BIGINT) AS idle_workers,
  count(*) - least(count(*), {WORKERS}) AS pending_tasks, least(count(*), {WORKERS}) AS active_tasks FROM nation""",
    "schedule_k_workers": f"""
WITH RECURSIVE e AS (SELECT * FROM ({_POOLS})),
s(pool, seq, call, worker, start, finish, free) AS (
  SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST({[0.0] * WORKERS} AS DOUBLE[]) FROM e
  UNION ALL
  SELECT s.pool, e.seq, e.call, s.w - 1, s.t, s.t + cents, list_transform(free, lambda x, i: CASE WHEN i = s.w THEN s.t + cents ELSE x END)
  FROM (SELECT pool, seq, free, list_min(free) AS t, CAST(list_position(free, list_min(free)) AS INTEGER) AS w FROM s) s JOIN e ON e.pool = s.pool AND e.seq = s.seq + 1)
SELECT pool, call, worker, start, finish, false AS timed_out FROM s WHERE seq > 0""",
    "timeout_policy": f"""
SELECT pool, call, 0 AS worker, finish - least(cents, 5000) AS start, finish, cents > 5000 AS timed_out
FROM (SELECT *, sum(least(cents, 5000)) OVER (PARTITION BY pool ORDER BY call ROWS UNBOUNDED PRECEDING) AS finish FROM ({_POOLS}))""",
    "fibonacci": """
WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0, 1 UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 14)
SELECT o_orderkey, o_custkey % 15 AS n, CAST(a AS BIGINT) AS fib FROM orders JOIN f ON f.n = o_custkey % 15""",
    "binary_len": "SELECT c_custkey, CAST(octet_length(encode(c_name)) AS BIGINT) AS n_bytes FROM customer",
}
