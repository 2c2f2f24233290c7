"""Tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def calls(spark: SparkSession, tuples: list[tuple], schema: str) -> DataFrame:
    """Argument tuples as rows, with ``seq`` in the order given."""
    return spark.createDataFrame([(i + 1, *t) for i, t in enumerate(tuples)], f"seq long, {schema}")
