"""Placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size, an arithmetic progression whose
offset and step come from the shard's name. Shards take turns and claim their first free preference until
no slot is free, so slots per shard differ by one at most, and adding or losing a shard moves few keys.
The table has a fixed size whatever the data, and is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; prime, and far more than shards. Also the bound on what is broadcast (about 1 MB).
SLOTS = 65537
SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number for each slot. ``slots`` must be prime and at least the number of shards."""
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be at least one shard and no more than slots")
    offset = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    place, table, left = offset[:], [-1] * slots, slots
    while True:
        for s in range(len(shards)):
            while table[place[s]] >= 0:
                place[s] = (place[s] + step[s]) % slots
            table[place[s]] = s
            left -= 1
            if not left:
                return table


def slot_of(column: str, slots: int = SLOTS):
    """The slot of a key: 32 bits of its md5 as text. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(slots)


def place_documents(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard`` (added columns replace equal names).

    Equal keys go to one shard; a null key has a place like any other; an empty table stays empty.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill_table(shards, slots))], "`__slot` bigint, `__shard` string")
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(key_col, slots))
    joined = placed.join(F.broadcast(table), F.col("slot") == F.col("__slot"), "left")
    return joined.withColumnRenamed("__shard", "shard").drop("__slot")


def write_shards(docs: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS, files: int = 8) -> None:
    """One folder a shard. Rows are dealt by slot group, so a shard has at most ``files`` files and no task holds a shard."""
    placed = place_documents(docs, shards, key_col, slots)
    placed.withColumn("__part", F.col("slot") % files).repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
