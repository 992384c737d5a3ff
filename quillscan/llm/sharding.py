"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: (offset + j * skip) mod size. Shards
take turns claiming their next free slot until the table is full, so shares differ by at most one slot, and a
change of the shard list moves few keys beside those of the shards that came or went. The table has a fixed
size and is broadcast; a key's shard is one lookup of its digest modulo the size. No shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: the shards and the prime number of slots, over a hundred for each shard.
SHARDS, SLOTS = 32, 4099
#: A table that is broadcast has at most this many rows.
MOST_SLOTS = 1_000_003


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots, from the first two 32-bit words of its name's MD5."""
    d = hashlib.md5(name.encode()).hexdigest()
    return int(d[:8], 16) % slots, int(d[8:16], 16) % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot. `slots` must be prime and not fewer than the shards, whose names must differ."""
    if len(set(names)) != len(names) or not names:
        raise ValueError("shard names must be given and differ")
    if not len(names) <= slots <= MOST_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime between the number of shards and MOST_SLOTS")
    owner = np.full(slots, -1, np.int64)
    order = [preference(n, slots) for n in names]
    at, left = [0] * len(names), slots
    while left:
        for k, (offset, skip) in enumerate(order):
            while owner[slot := (offset + at[k] * skip) % slots] >= 0:
                at[k] += 1
            owner[slot] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 32 bits of its MD5 modulo the table's size; a null key counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("long")


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (the shard's name); columns of these names are replaced, a key of such a name is read first.

    Equal keys share a shard; null keys form one key. The broadcast table has `slots` rows, at most MOST_SLOTS.
    """
    owner = fill(names, slots)
    table = df.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(owner.tolist())], "slot long, shard string")
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return placed.join(F.broadcast(table), "slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


#: The same table by recursion: one claim a step; the state is the table and each shard's place in its order.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 5, '0') AS name,
         ('0x' || substr(md5('shard-' || lpad(CAST(k AS VARCHAR), 5, '0')), 1, 8))::BIGINT % {SLOTS} AS o,
         ('0x' || substr(md5('shard-' || lpad(CAST(k AS VARCHAR), 5, '0')), 9, 8))::BIGINT % {SLOTS - 1} + 1 AS s
  FROM range({SHARDS}) t(k)),
prefs AS (SELECT list(o ORDER BY k) AS os, list(s ORDER BY k) AS ss FROM shards),
claims AS (
  SELECT 0 AS step, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner, -1::BIGINT AS slot
  UNION ALL
  SELECT step + 1,
         list_concat(list_concat(owner[1:f], [step % {SHARDS}]), owner[f + 2:]), f
  FROM (SELECT step, owner,
               list_first(list_filter(list_transform(range({SLOTS}), lambda j: (os[step % {SHARDS} + 1] + j * ss[step % {SHARDS} + 1]) % {SLOTS}), lambda x: owner[x + 1] < 0)) AS f
        FROM claims, prefs WHERE step < {SLOTS})),
filled AS (SELECT slot, (step - 1) % {SHARDS} AS k FROM claims WHERE step > 0)
SELECT doc_id, d.slot AS slot, shards.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN filled ON filled.slot = d.slot JOIN shards ON shards.k = filled.k
"""
