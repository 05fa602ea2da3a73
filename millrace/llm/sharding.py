"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has its own permutation of the table's slots (an offset and a step, both from its name). Shards take turns
claiming the next free slot of their permutation until the prime-sized table is full, so that shares differ by one
slot at most, and adding or removing a shard moves little more than its own share. A key's slot is its hash modulo
the table's size, and the broadcast table (of a fixed number of slots) gives its shard.

A key that holds more than a shard's fair share of rows can be spread: its rows get several keys in turn.

Defined results: a null key counts as the empty text. Equal keys share a shard unless spread. Repeated rows are rows
of their own; an empty table gives an empty result. Columns named slot or shard are replaced, others stay as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, over a hundred times the usual number of shards.
SLOTS = 10_007


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Shards claim in turn; the table's size is a parameter, so this is bounded."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    offset = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    turn, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at := (offset[k] + turn[k] * step[k]) % slots] >= 0:
                turn[k] += 1
            table[at] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of its MD5 modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def spread_keys(rows: DataFrame, key: str, by: str, n_shards: int) -> Column:
    """The key, made several keys in turn (by the hash of `by`) where it holds more than a shard's share of rows.

    Counts are combined before the shuffle, and no more than n_shards keys can hold that much.
    """
    counts = rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = counts.filter(F.col("n") * n_shards > total).collect()
    ways = F.create_map(*[F.lit(x) for r in hot for x in (r["k"], -(-r["n"] * n_shards // max(total, 1)))]) if hot else None
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if ways is None:
        return text
    turn = F.pmod(F.xxhash64(by), F.coalesce(F.try_element_at(ways, text), F.lit(1)).cast("long"))
    return F.when(turn > 0, F.concat(text, F.lit("#"), turn.cast("string"))).otherwise(text)


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, spread_by: str | None = None) -> DataFrame:
    """Add shard (its name) and slot to rows."""
    spark = rows.sparkSession
    table = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")).alias("__slot", "__shard"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = table.select("__slot", F.element_at(names, F.col("__shard").cast("int") + 1).alias("__shard"))
    asked = spread_keys(rows, key, spread_by, len(shards)) if spread_by else F.col(key)
    placed = rows.withColumn("__at", slot_of(asked, slots)).join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    columns = [c for c in rows.columns if c not in ("slot", "shard")]
    return placed.select(*columns, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
