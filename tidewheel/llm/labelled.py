"""Labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """text and y (0 or 1) of at most ``limit`` labelled documents outside the held-out fold, chosen by hash.

    Rows of ``labels`` with a null id or label are left out; if an id has several, the largest
    label counts. The chosen labels are bounded, so they are broadcast to the documents.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)").where(fold("_id") != 0)
    chosen = usable.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = documents.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "y")
