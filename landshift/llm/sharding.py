"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: an
offset and a step, both from a digest of its name, walk through all slots. Shards take
turns; in its turn a shard claims its first slot that is still free. Slot counts differ
by one at most, and when a shard comes or goes few slots change their owner. A row goes
to the owner of slot ``digest(key) mod size``: one lookup in a small table.

Main path: DataFrame functions only. The table has ``size`` rows, at most ``MAX_SIZE``,
so the broadcast is bounded by a parameter and never by the data. Placing shuffles nothing,
whatever key is hot.

Defined results: a null key is placed as the empty text; equal keys share a shard; empty
tables give empty results; a column of the same name as the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIZE = 65_537
DIGITS = 12  # hexadecimal digits of a digest that are used


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots."""
    number = lambda kind: int(hashlib.md5(f"{kind}:{shard}".encode()).hexdigest()[:DIGITS], 16)
    return number("offset") % size, number("step") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Owner (an index into ``shards``) of every slot. A prime size makes each walk reach all slots."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("name at least one shard, each once")
    if not is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"the size must be a prime between the number of shards and {MAX_SIZE}")
    owner = [-1] * size
    walks = [preference(name, size) for name in shards]
    tried = [0] * len(shards)
    for turn in range(size):
        shard = turn % len(shards)
        offset, step = walks[shard]
        while owner[(offset + tried[shard] * step) % size] >= 0:
            tried[shard] += 1
        owner[(offset + tried[shard] * step) % size] = shard
    return owner


def slot(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def lookup(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """The table as rows (slot, owner)."""
    listed = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "owner")).select("slot", F.col("owner").cast("int"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = 4_099, name: str = "shard") -> DataFrame:
    """``rows`` with the index of their shard in column ``name``."""
    table = F.broadcast(
        lookup(rows.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("owner").alias("__owner"))
    )
    kept = [c for c in rows.columns if c != name]
    placed = rows.withColumn("__slot", slot(rows[key], size)).join(table, "__slot")
    return placed.select(*kept, F.col("__owner").alias(name))


def write_shards(placed: DataFrame, path: str, name: str = "shard") -> None:
    """One folder per shard. Rows are gathered by shard, and large shards are split over several tasks."""
    placed.hint("rebalance", name).write.partitionBy(name).parquet(path)
