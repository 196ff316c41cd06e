"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table, a permutation given by an offset and
a step drawn from its name. Shards take turns claiming their next free slot until the table is full, so each owns
the same number of slots but for one, and adding or removing a shard moves few others' slots. A row's slot is a
hash of its key modulo the table; the table (as many rows as the prime) is broadcast, so placing a row is one look-up
and no row moves. ``weights`` lets a shard take several turns a round.

A key always has one shard. Where one key may hold much of the rows, give ``spread_col``: its value joins the key
in the hash, and the key's rows spread over the shards.

Cases: a null key is a key of its own; equal keys have equal slots; rows repeat as they come; an empty table gives
an empty result; columns that clash with the new ones make these take another name (``with_shards``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, hash60

TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it. Shards take turns in the order of their names."""
    names = sorted(set(shards))
    if not names or not is_prime(size) or size < len(names):
        raise ValueError("give at least one shard and a prime table size of at least the number of shards")
    place, step = [], []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    turns = [max(0, int((weights or {}).get(name, 1))) for name in names]
    if not any(turns):
        raise ValueError("every shard has the weight 0")
    table, free = [-1] * size, size
    while free:
        for i in range(len(names)):
            for _ in range(min(turns[i], free)):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % size
                table[place[i]] = i
                free -= 1
    return table


def with_shards(df: DataFrame, key_col: str, shards=SHARDS, size: int = TABLE_SIZE, spread_col: str | None = None,
                weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with slot and shard."""
    names = sorted(set(shards))
    table = lookup_table(names, size, weights)
    slot, shard = fresh(df.columns, "slot"), fresh(df.columns, "shard")
    owners = df.sparkSession.createDataFrame([(s, names[i]) for s, i in enumerate(table)], f"`{slot}` long, `{shard}` string")
    key = col(key_col)
    if spread_col:
        key = F.to_json(F.struct(key.alias("k"), col(spread_col).alias("s")))
    placed = df.withColumn(slot, F.pmod(hash60(key), F.lit(size)))
    # the table has exactly ``size`` rows
    return placed.join(F.broadcast(owners), slot).select(*[col(c) for c in df.columns], col(slot), col(shard))


def write_shards(df: DataFrame, path: str, key_col: str, files_per_shard: int = 8, **options) -> None:
    """Parquet folders per shard; a shard's rows are dealt to ``files_per_shard`` writers by a hash of the whole row."""
    placed = with_shards(df, key_col, **options)
    shard = placed.columns[-1]
    part = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(col(shard), part).write.mode("overwrite").partitionBy(shard).parquet(path)
