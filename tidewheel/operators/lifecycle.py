"""Calls with a hook before and after each partition.

Spark partitions are not workers: the hooks run once for each partition's task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def map_with_hooks(df: DataFrame, function: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, on_create: Callable[[], Any] | None = None, on_terminate: Callable[[Any], None] | None = None, deadline_s: float | None = None) -> DataFrame:
    """``function(state, rows)`` over batches; ``on_create`` gives the state, ``on_terminate`` runs even after an error.

    With ``deadline_s`` a partition that has run longer stops at the next batch with an error:
    the cooperative form of a deadline, as Spark ends a Python worker without a callback.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, began = on_create() if on_create else None, time.monotonic()
        try:
            for rows in batches:
                if deadline_s is not None and time.monotonic() - began > deadline_s:
                    raise RuntimeError(f"partition ran past {deadline_s} s")
                yield function(state, rows)
        finally:
            if on_terminate:
                on_terminate(state)

    return df.mapInPandas(run, schema)
