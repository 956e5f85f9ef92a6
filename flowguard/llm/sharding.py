"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: start ``offset``, then
steps of ``skip``. Shards take turns, each claiming the next free slot of its order, until the
table is full; with a weight below 1 a shard sits out some turns. Slots differ by one turn at most,
and a changed set of shards moves few of the other slots. The table has a fixed size that does not
depend on the data, so it is broadcast and a row finds its shard with one hash lookup.

Placement is by the key's text form. Equal keys share a shard; a null key is placed like the empty
text. An empty table gives no rows. Other columns are kept by ``place``, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def _order(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).digest()
    return (int.from_bytes(digest[:8], "big") % size,
            int.from_bytes(digest[8:], "big") % (size - 1) + 1)


def fill(shards: list[str], size: int = TABLE_SIZE, weights: list[float] | None = None) -> list[int]:
    """The table: for each slot the place of its shard in ``shards``."""
    if not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    weights = weights or [1.0] * len(shards)
    if min(weights) <= 0 or max(weights) > 1:
        raise ValueError("weights are above 0, 1 at most")
    orders = [_order(s, size) for s in shards]
    table, step, due, left = [-1] * size, [0] * len(shards), [0.0] * len(shards), size
    while True:
        for k, (offset, skip) in enumerate(orders):
            due[k] += weights[k]
            if due[k] < 1:
                continue
            due[k] -= 1
            slot = (offset + step[k] * skip) % size
            while table[slot] >= 0:
                step[k] += 1
                slot = (offset + step[k] * skip) % size
            table[slot], step[k], left = k, step[k] + 1, left - 1
            if not left:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot by the first 60 bits of the MD5 of the key's text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as rows (slot, shard), made by SQL functions from one constant."""
    slots = F.from_json(F.lit(json.dumps(table)), "array<int>")
    return spark.range(1).select(F.posexplode(slots).alias("slot", "shard")).select(
        F.col("slot").cast("long").alias("slot"), "shard")


def _fresh(docs: DataFrame, count: int) -> list[str]:
    """Column names that ``docs`` does not have, in any case of letters."""
    taken, width = {c.lower() for c in docs.columns}, 1
    while any(f"{'_' * width}{k}" in taken for k in range(count)):
        width += 1
    return [f"{'_' * width}{k}" for k in range(count)]


def place(docs: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
          weights: list[float] | None = None, out: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with the columns ``slot`` and ``out``; columns of these names are replaced."""
    own, shard, at = _fresh(docs, 3)
    table = lookup(docs.sparkSession, fill(shards, size, weights))
    table = table.select(F.col("slot").alias(own), F.col("shard").alias(shard))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (out, slot)]
    rows = docs.select(*kept, slot_of(F.col(f"`{key}`"), size).alias(at))
    return (rows.join(F.broadcast(table), F.col(at) == F.col(own))
            .select(*kept, F.col(at).alias(slot), F.col(shard).alias(out)))


def write_shards(docs: DataFrame, path: str, key: str, shards: list[str], **options) -> None:
    """One folder per shard. Every task writes its own file in it, so no shard is one task's work."""
    place(docs, key, shards, **options).drop("slot").write.partitionBy("shard").parquet(path)
