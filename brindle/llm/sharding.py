"""Sharding through a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table; in turn, each shard claims the next free
slot of its preference order until the table is full. The shards' shares of slots differ by one at most, and few
slots change hands when a shard comes or goes. Placement is one hash and one probe of the broadcast table, whose
size is the parameter ``slots``.

Defined results: the key is cast to a string; null keys are placed by a fixed text of their own; equal keys share a
shard; an empty table gives an empty table; further columns pass through, but for those named like the added ones,
which these replace.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

NULL_KEY = "\x00null"
#: A hundred slots a shard keep the shares within a hundredth; the table's size is bounded.
SHARDS, SLOTS, MAX_SLOTS = 40, 4099, 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot, the position in ``shards`` of its owner."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of {MAX_SLOTS} at most")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and as many as slots at most")
    places, steps = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        places.append(int.from_bytes(digest[:8], "big") % slots)
        steps.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while owner[places[i]] >= 0:
                places[i] = (places[i] + steps[i]) % slots
            owner[places[i]] = i
            left -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its MD5 hash, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def shard(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds the slot and the shard's position (both long) of each row's key. A row per row of ``df``."""
    owner = ",".join(map(str, fill_table(shards, slots)))
    table = df.sparkSession.range(slots).select(
        F.col("id").alias(slot_col),
        F.element_at(F.split(F.lit(owner), ","), (F.col("id") + 1).cast("int")).cast("bigint").alias(shard_col),
    )
    (slot,) = fresh(df.columns, "_slot")
    placed = df.withColumn(slot, slot_of(F.col(key), slots)).drop(slot_col, shard_col).withColumnRenamed(slot, slot_col)
    return placed.join(F.broadcast(table), slot_col, "inner")
