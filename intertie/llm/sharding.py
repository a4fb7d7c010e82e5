"""Placement of rows on shards through a lookup table that the shards fill in turns.

Every shard orders the slots of a table of prime size by a permutation of its
own. The shards take turns; each claims the first slot of its order that is
still free, until none is. So slots differ by at most one between shards, and
when a shard leaves, few slots change hands. A row's key hashes to a slot; the
table is broadcast, so placing a row is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation; any step below a prime size visits every slot."""
    digest = hashlib.md5(shard.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def fill(shards: list[str], size: int) -> list[int]:
    """Owner (index into ``shards``) of every slot. Its length is ``size``, whatever the data are."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names of their own, and at least one is needed")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime number, and not below the number of shards")
    orders = [preference(shard, size) for shard in shards]
    tried = [0] * len(shards)
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        first, step = orders[shard]
        while True:
            slot = (first + tried[shard] * step) % size
            tried[shard] += 1
            if owner[slot] < 0:
                owner[slot] = shard
                break
    return owner


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the size; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """The filled table as rows of ``slot``, ``shard`` (index) and ``shard_name``."""
    owners = ",".join(map(str, fill(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.col("owner").cast("int").alias("shard")).withColumn(
        "shard_name", F.get(names, F.col("shard"))
    )


def place(rows: DataFrame, key: str, shards: list[str], size: int = 4099) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` and ``shard_name``; columns of these names are replaced.

    Every row is kept, repeated ones too, and equal keys go to the same shard.
    """
    kept = rows.drop(*[c for c in ("slot", "shard", "shard_name") if c in rows.columns and c != key])
    if key in ("slot", "shard", "shard_name"):
        raise ValueError(f"rename the key column, {key} is an output column")
    # ``size`` rows, whatever the data are.
    table = F.broadcast(lookup_table(rows.sparkSession, shards, size))
    return kept.withColumn("slot", slot_of(F.col(key), size)).join(table, "slot").select(
        *[F.col(c) for c in kept.columns], "slot", "shard", "shard_name"
    )


def fill_sql(names: str, shards: int, size: int) -> str:
    """SQL for rows (slot, shard) of the filled table; ``names`` gives a shard's name from its index ``i``."""
    return f"""
      orders AS (
        SELECT list(('0x' || substr(md5({names}), 1, 8))::BIGINT % {size} ORDER BY i) AS firsts,
               list(('0x' || substr(md5({names}), 9, 8))::BIGINT % {size - 1} + 1 ORDER BY i) AS steps
        FROM range(0, {shards}) t(i)),
      filled(turn, owner) AS (
        SELECT 0::BIGINT, list_transform(range(0, {size}), lambda x: -1::BIGINT)
        UNION ALL
        SELECT turn + 1, list_concat(list_concat(owner[1:slot], [turn % {shards}]), owner[slot + 2:])
        FROM (SELECT turn, owner,
                     list_filter(list_transform(range(0, {size}),
                                 lambda j: (firsts[turn % {shards} + 1] + j * steps[turn % {shards} + 1]) % {size}),
                                 lambda s: owner[s + 1] = -1)[1] AS slot
              FROM filled, orders WHERE turn < {size})),
      slots AS (
        SELECT unnest(range(0, {size})) AS slot, unnest(owner) AS shard FROM filled WHERE turn = {size})"""
