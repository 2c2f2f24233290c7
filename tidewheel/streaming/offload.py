"""Calls over a stream of arguments, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.offload import call_safe


def offload_stream(stream: DataFrame, function: Callable, columns: list[Column | str], returns: str, **options: Any) -> DataFrame:
    """The stream with an ``envelope`` column: a failing call does not stop the stream."""
    return stream.withColumn("envelope", call_safe(function, *columns, returns=returns, **options))


def run_to(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch of what is there to ``sink`` and stops; the checkpoint makes a restart go on from there."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
