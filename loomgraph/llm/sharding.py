"""Placement of keys on shards by a permutation-filled lookup table (Maglev hashing).

Every shard has a preference order of the slots of a table of prime size, a
permutation given by an offset and a step. Shards take turns; each claims the
first slot of its order that is still free, until the table is full. So shards
own equal numbers of slots, and when a shard goes, few other slots change hands.

The table has a fixed size, chosen by the caller and independent of the data,
and is made on the driver and spread out by one split of a constant. On the data, placement is a hash, a remainder and a
join with the broadcast table: DataFrame functions only, one narrow stage, so a
hot key costs no more than any other.

Defined cases: a null key has the slot of the empty text; equal keys share a
shard; an empty table gives an empty table; existing columns named like the new
ones are replaced, all others pass unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime about a thousand times the number of shards keeps their loads within a per cent.
TABLE_SIZE = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if size < len(shards) or size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, at least the number of shards")
    offset = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, slot, free = [-1] * size, list(offset), size
    while True:
        for k in range(len(shards)):
            while table[slot[k]] >= 0:
                slot[k] = (slot[k] + step[k]) % size
            table[slot[k]] = k
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """32 bits of the key's MD5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(size))


def shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, slot: str = "slot", name: str = "shard") -> DataFrame:
    """``df`` with the slot of its key and the name of the shard that owns it."""
    rest = [c for c in df.columns if c not in (slot, name)]
    # a row for each slot: the size of what is broadcast is fixed by the parameter
    listed = F.split(F.lit(" ".join(f"{k:x}" for k in fill_table(shards, size))), " ")
    owner = F.element_at(F.array(*[F.lit(s) for s in shards]), F.conv("digits", 16, 10).cast("int") + 1)
    table = df.sparkSession.range(1).select(F.posexplode(listed).alias("at", "digits")).select(F.col("at").cast("bigint").alias("at"), owner.alias("owner"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("cols"), slot_of(F.col(f"`{key}`"), size).alias("at"))
    placed = rows.join(F.broadcast(table), "at")
    return placed.select(*[F.col(f"cols.`{c}`").alias(c) for c in rest], F.col("at").alias(slot), F.col("owner").alias(name))


def shard_sql(shards: list[str], size: int = TABLE_SIZE, key: str = "doc_id", table: str = "documents") -> str:
    """The same placement as SQL for DuckDB."""
    names = ", ".join("'" + s.replace("'", "''") + "'" for s in shards)
    listed = " ".join(f"{k:x}" for k in fill_table(shards, size))
    return f"""
    WITH placed AS (
        SELECT {key}, CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 8)) AS BIGINT) % {size} AS slot FROM {table}),
    owners AS (SELECT [{names}] AS shards, string_split('{listed}', ' ') AS digits)
    SELECT {key}, slot, shards[CAST(('0x' || digits[slot + 1]) AS INTEGER) + 1] AS shard FROM placed, owners"""
