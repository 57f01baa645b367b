"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own
(an offset and a step from hashes of its name) and the shards take turns, each
claiming the first slot in its order that is still free, until none is. A row
belongs to slot ``hash(key) mod size`` and to the shard that holds it. All shards
get the same number of slots within one (within their weights, if given), and
taking a shard out moves few rows beyond its own.

The table has ``size`` entries whatever the data, so it is broadcast and a row
costs one probe: no shuffle, no Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    return _hash(f"{name}/offset") % size, _hash(f"{name}/step") % (size - 1) + 1


def lookup_table(shards: Sequence[str] = SHARDS, size: int = SIZE, turns: Sequence[int] | None = None) -> list[int]:
    """For each slot the index of its shard.

    ``size`` must be a prime not below the number of shards; ``turns`` (default
    one each) is how many slots a shard claims whenever its turn comes.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size {size} is no prime of at least {len(shards)}")
    turns = list(turns or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("one number of turns per shard, not all zero")
    order = [preference(s, size) for s in shards]
    taken, tried, free = [-1] * size, [0] * len(shards), size
    while free:
        for i, (offset, step) in enumerate(order):
            for _ in range(min(turns[i], free)):
                while taken[slot := (offset + tried[i] * step) % size] >= 0:
                    tried[i] += 1
                taken[slot] = i
                free -= 1
    return taken


def slot_of(*keys: str, size: int = SIZE) -> Column:
    """Slot of a row by its key columns; a null counts as an empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.pmod(digest, F.lit(size).cast("long"))


def table_frame(spark: SparkSession, shards: Sequence[str], taken: Sequence[int]) -> DataFrame:
    """The lookup table as rows (_slot, _shard)."""
    names = F.split(F.lit("\x1f".join(shards[i] for i in taken)), "\x1f")
    return spark.range(1).select(F.posexplode(names).alias("_slot", "_shard"))


def place(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[str] = SHARDS,
    size: int = SIZE,
    turns: Sequence[int] | None = None,
    slot: str = "slot",
    shard: str = "shard",
) -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Rows with equal keys get the same shard, repeated rows too; null keys count as
    empty texts; an empty table stays empty. Columns of ``df`` named like the new
    ones are replaced. Rows do not move: partition the result by ``shard`` to write it.
    """
    placed = df.drop(slot, shard).withColumn(slot, slot_of(*keys, size=size))
    lookup = F.broadcast(table_frame(df.sparkSession, shards, lookup_table(shards, size, turns)))
    return placed.join(lookup, F.col(slot) == F.col("_slot")).drop("_slot").withColumnRenamed("_shard", shard)
