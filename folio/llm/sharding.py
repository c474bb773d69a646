"""Sharding by a permutation-filled lookup table of prime size.

Each shard has its own order of preference over the table's slots: offset, offset + skip, offset + 2 skip, ... modulo
the prime. Shards take turns, each claiming the first slot of its order that is free, until none is; so shards own
equal numbers of slots up to one, and removing a shard moves few of the other shards' keys. The table has `slots`
rows of two integers whatever the data's size (65,537 by default, about half a megabyte), so it is broadcast; placing
a document is one hash and one lookup.

Defined cases: a null key is placed like any other value; equal keys go to the same shard; an empty table gives an
empty result; shard names must be distinct. Only the key column is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of the shard that owns it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct, and at least one is needed")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime, not below the number of shards")
    place, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            owner[place[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column: 60 bits of the MD5 of its text, modulo the table's size; a null key hashes as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """key, slot (long), shard (string), a row for each row of `docs`."""
    spark: SparkSession = docs.sparkSession
    names = list(shards)
    table = spark.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    return docs.select(F.col(key), slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(table), "slot", "left").select(key, "slot", "shard")
