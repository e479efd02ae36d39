"""Sharding by a permutation-filled lookup table.

Every shard walks all slots of a prime-sized table in an order of its own (offset + k * skip); the shards take turns, each
claiming the first slot of its order that is still free, until the table is full. A row's hash picks a slot. Slots differ
by at most one a shard, and a shard added or lost moves few rows beyond its own.

The table has a fixed number of rows (``SLOTS``), whatever the data, so it is broadcast. Defined results: a null key counts as empty text; equal keys share a shard; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SHARDS = 4099, 32


def _number(text: str) -> int:
    """60 bits of MD5, which SQL can compute too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For every slot the number of the shard that owns it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, at least the number of shards")
    place = [_number(f"{s}:offset") % slots for s in shards]
    skip = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    owner, filled = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            owner[place[shard]] = shard
            filled += 1
            if filled == slots:
                return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    rows = [(slot, shards[owner]) for slot, owner in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    hashed = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``rows`` with their slot and shard (``names``); one broadcast hash join, no exchange of rows."""
    taken = {c.lower() for c in rows.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already: give other names")
    found = lookup_table(rows.sparkSession, shards, slots).select(F.col("slot").alias(names[0]), F.col("shard").alias(names[1]))
    return rows.withColumn(names[0], slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(found), names[0])


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """One folder a shard; a shard's rows are spread over files by slot, so no task holds a whole shard."""
    placed = place(rows, key, shards, slots)
    placed.repartition("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:03d}" for k in range(n)]
