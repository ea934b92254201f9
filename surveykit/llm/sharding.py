"""Consistent sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own
(``offset + i * skip``). The shards take turns, each claiming its next free slot, until
the table is full, so shares differ by one slot at most, and adding or removing a shard
moves few keys. A key is placed by one lookup in the broadcast table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_number, temp_name

#: The table has at least this many slots per shard (shares then differ by under 1 %).
SLOTS_PER_SHARD = 100
#: Bound on the broadcast table.
MAX_SLOTS = 10_000_000


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def lookup_table(shards: Sequence[str], slots: int | None = None) -> list[int]:
    """Slot → index of the shard that holds it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be non-empty and distinct")
    size = next_prime(slots or SLOTS_PER_SHARD * len(shards))
    if size > MAX_SLOTS:
        raise ValueError(f"a table of {size} slots is over the broadcast bound of {MAX_SLOTS}")
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    at = [number(f"{s}#offset") % size for s in shards]
    skip = [number(f"{s}#skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
    return table


def assign_shards(df: DataFrame, shards: Sequence[str], key: Column | str,
                  fallback: Column | None = None, shard_col: str = "shard",
                  slot_col: str = "slot", slots: int | None = None) -> DataFrame:
    """Add each row's slot and shard.

    No shuffle: one broadcast lookup per row. Rows of one key share a shard; a null key
    falls back to ``fallback`` (else the empty key), so that a third of rows with a null
    key still spread. Existing columns of the two names, in any case, are replaced; no row is
    lost, repeated ones neither; an empty table gives an empty one.
    """
    table = lookup_table(shards, slots)
    text = F.coalesce(F.col(key) if isinstance(key, str) else key).cast("string")
    if fallback is not None:
        text = F.coalesce(text, F.concat(F.lit("~"), F.md5(F.coalesce(fallback.cast("string"), F.lit("")))))
    text = F.coalesce(text, F.lit(""))
    slot, name, at = temp_name(df, "slot"), temp_name(df, "shard"), temp_name(df, "at")
    lookup = (df.sparkSession.range(1)
              .select(F.posexplode(F.lit(table)).alias(at, name))
              .select(at, F.element_at(F.lit(list(shards)), F.col(name) + 1).alias(name)))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    placed = df.withColumn(slot, F.pmod(md5_number(text), F.lit(len(table))).cast("int"))
    return (placed.join(F.broadcast(lookup), F.col(slot) == F.col(at), "left")
            .select(*keep, F.col(slot).alias(slot_col), F.col(name).alias(shard_col)))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 8) -> None:
    """Write one folder per shard; the rows of a shard are salted over several files."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    (df.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path))
