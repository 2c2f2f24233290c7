"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (start and step
from its name). Shards take turns, in proportion to their weights, and claim the next free
slot of their order until the table is full. The table is fixed by the shard names and its
size alone, so it is filled once on the driver (``table_size`` entries, a bound that does
not depend on the data) and broadcast; a row's shard is one look-up.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE, weights: list[float] | None = None) -> np.ndarray:
    """Shard index of every slot. A shard of weight w takes a turn w times as often as one of weight 1."""
    if not is_prime(table_size):
        raise ValueError("table_size must be prime, so that every step visits all slots")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct names, at least one and at most table_size")
    weights = [1.0] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a weight of 0 or more for each shard, and one above 0")
    start = [xxhash.xxh64_intdigest(s, seed=1) % table_size for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (table_size - 1) + 1 for s in shards]
    heaviest = max(weights)
    credit = [0.0] * len(shards)
    out = np.full(table_size, -1, dtype=np.int32)
    free = table_size
    while free:
        for i in range(len(shards)):
            credit[i] += weights[i] / heaviest
            if credit[i] < 1:
                continue
            credit[i] -= 1
            slot = start[i]
            while out[slot] >= 0:
                slot = (slot + step[i]) % table_size
            out[slot] = i
            start[i] = (slot + step[i]) % table_size
            free -= 1
            if not free:
                break
    return out


def slot_of(keys: list[str], table_size: int) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def assign(df: DataFrame, keys: list[str], shards: list[str] | None = None, table_size: int = TABLE_SIZE, weights: list[float] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Adds the slot and the shard (index into ``shards``) of each row.

    The slot is the first 60 bits of the MD5 of the keys' texts (a unit separator between
    them) mod table_size, which other systems can compute as well. A null key counts as an
    empty text, so rows with null keys have a place too. Equal keys always share a shard; give a unique key (not a source or language) where one value may hold a
    large part of the rows. Columns named like the added ones are replaced. An empty table
    stays empty. The look-up is a map-side join with the broadcast table: no shuffle.
    """
    names = shards or [f"shard-{i}" for i in range(SHARDS)]
    lookup = lookup_table(names, table_size, weights)
    spark = df.sparkSession
    places = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lookup)], f"`{slot}` int, `{shard}` int")
    keyed = df.withColumn(slot, slot_of(keys, table_size)).drop(shard)
    return keyed.join(F.broadcast(places), slot, "left")


def write_shards(df: DataFrame, path: str, keys: list[str], shards: list[str] | None = None, files_per_shard: int = 4, **options) -> None:
    """Writes one folder per shard; ``files_per_shard`` tasks share a shard, so no task holds a whole one."""
    placed = assign(df, keys, shards, **options)
    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit("file")), F.lit(files_per_shard))
    count = len(shards or range(SHARDS)) * files_per_shard
    placed.repartition(count, F.col("shard"), salt).write.mode("overwrite").partitionBy("shard").parquet(path)
