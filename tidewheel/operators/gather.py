"""A gapless sequence over a whole table, and results in the order of submission."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir, which a cluster must name; a single machine may do without."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidewheel-"))
    return df.checkpoint()


def with_sequence(df: DataFrame, *order: Column | str, name: str = "seq") -> DataFrame:
    """Adds the place (from 1) of each row in ``order``, which should be total.

    Rows are range-sorted, so every executor has a part of the order; only the number of
    rows of each part comes to the driver. A window over the whole table would send it to
    one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    part, base, before = F.shiftright("_id", 33), [], 0
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        base.append((r["part"], before))
        before += r["count"]
    bases = F.broadcast(spark.createDataFrame(base, "_part long, _before long"))  # one row per partition
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(bases, "_part").withColumn(name, place).drop("_part", "_id", "_before")


def gather(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Results in the order of submission."""
    return df.orderBy(seq)
