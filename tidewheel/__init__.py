"""A task-offload layer over Spark: functions applied to rows of arguments, and jobs under control."""

from pyspark.sql import SparkSession

from .errors import CancellationError, QueueFullError, RemoteError, TerminateError, TimeoutError
from .functions.registry import Registry, worker
from .operators.offload import add_abort_listener, call, call_safe, emit, is_main_thread
from .plans.future import TaskFuture, defer, gather_all
from .plans.pool import Pool, PoolOptions, pool

platform = "spark"


def cpus(spark: SparkSession) -> int:
    """Cores that Spark has for tasks; a pool has one worker less by default."""
    return spark.sparkContext.defaultParallelism


__all__ = ["CancellationError", "Pool", "PoolOptions", "QueueFullError", "Registry", "RemoteError", "TaskFuture", "TerminateError", "TimeoutError", "add_abort_listener", "call", "call_safe", "cpus", "defer", "emit", "gather_all", "is_main_thread", "platform", "pool", "worker"]
