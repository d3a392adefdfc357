"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime
size: slots offset, offset + skip, offset + 2 skip, ... modulo the size, which
visits every slot once.  The shards take turns; in its turn a shard claims its
next preferred slot that is still free (a shard of weight w takes w turns a
round).  A row's slot is its key's hash modulo the size, its shard is the
slot's owner.  Shards own nearly equal numbers of slots, and adding or
removing one moves little else.

The table has ``table_size`` rows whatever the data (``MAX_TABLE`` at most),
so its broadcast is bounded and a row is placed in constant time, without a
shuffle.

Defined cases: a null key is placed like the empty string; equal keys share a
shard; an empty table stays empty; all columns of the input are kept, and
clashing names raise ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: dict[str, int] | list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """Owner of every slot, as an index into ``shards`` (names, or names with integer weights).

    Preference orders depend on a shard's name alone and turns go by name, so the order of ``shards`` doesn't matter.
    """
    weights = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or min(weights.values()) < 1:
        raise ValueError("at least one shard, and weights of 1 or more")
    if not _is_prime(table_size) or not sum(weights.values()) <= table_size <= MAX_TABLE:
        raise ValueError(f"table_size must be a prime of at most {MAX_TABLE} that gives each turn a slot")
    index = {name: i for i, name in enumerate(weights)}
    turns = sorted(weights)
    digest = {s: hashlib.sha256(s.encode()).digest() for s in turns}
    position = {s: int.from_bytes(digest[s][:8], "big") % table_size for s in turns}
    skip = {s: int.from_bytes(digest[s][8:16], "big") % (table_size - 1) + 1 for s in turns}
    owner = [-1] * table_size
    free = table_size
    while True:
        for s in turns:
            for _ in range(weights[s]):
                if not free:
                    return np.array(owner, dtype=np.int32)
                at, step = position[s], skip[s]
                while owner[at] >= 0:
                    at = (at + step) % table_size
                owner[at] = index[s]
                position[s] = (at + step) % table_size
                free -= 1


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(table_size)).cast("int")


def place(df: DataFrame, key: Column, shards: dict[str, int] | list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with its slot (int) and shard (string) added."""
    if clash := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    names = list(shards)
    spark = df.sparkSession
    table = spark.createDataFrame([(i, names[s]) for i, s in enumerate(fill_table(shards, table_size).tolist())], "slot int, shard string")
    return df.withColumn("slot", slot_of(key, table_size)).join(F.broadcast(table), "slot").select(*(F.col(f"`{c}`") for c in df.columns), "slot", "shard")
