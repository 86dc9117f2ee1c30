"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (offset and skip, both
hashed from the shard's name).  The shards take turns: at its turn a shard claims its most
preferred slot that is still free, until the table is full.  A row goes to the shard that owns
slot ``hash(key) mod size``, so that placement is one lookup, shares are even within about
shards / size, and few rows move when a shard joins or leaves.

Null keys are placed by the empty key; repeated rows go to the same shard; an empty table gives an
empty result.  All columns of the input are kept; ``slot`` and ``shard`` replace columns of the
same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SIZE = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The shard number of each slot.  Bounded by ``size``, whatever the data."""
    if not is_prime(size) or size < len(shards) or not shards or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size of at least the number of distinct shards")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest]
    table, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            if not left:
                break
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            left -= 1
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``.  The broadcast table has ``size`` rows: a parameter, not data."""
    shards = shards or shard_names()
    owners = ",".join(map(str, fill_table(shards, size)))
    spark = df.sparkSession
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def sql(shards: int = SHARDS, size: int = SIZE) -> str:
    owners = ",".join(map(str, fill_table(shard_names(shards), size)))
    return f"""
    WITH placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {size} AS slot FROM documents),
    owners AS (SELECT string_split('{owners}', ',') AS o)
    SELECT doc_id, slot, CAST(o[slot + 1] AS INTEGER) AS shard FROM placed, owners"""
