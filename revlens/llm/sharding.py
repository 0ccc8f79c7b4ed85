"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size (an offset and
a step, hashed from its name).  The shards take turns; at its turn a shard claims the next
free slot of its permutation, until all slots are taken.  Shards then differ by at most
one slot, and when a shard comes or goes few slots change hands.  A row's slot is a hash
of its key modulo the table size, so placement is one lookup in the broadcast table.  The
table has TABLE_SIZE rows whatever the data, which bounds the broadcast.

Defined results: the key is the doc_id; a null doc_id is placed by its text (null: as
empty).  Repeated rows go to the same shard; the hash deals out the rows of one source or
one group of copies like any others.  Extra columns stay; a clashing name is replaced by
the operator's column.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE_SIZE = 65_537  # prime, about a thousand slots for each of the default shards
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for each slot."""
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the table size must be a prime and no smaller than the number of shards")
    offset = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, left, at = [-1] * size, size, list(offset)
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a text key: the first 60 bits of its MD5, modulo the table size."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    owner = lookup_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({"slot": range(size), "shard": owner}), "slot int, shard int")


def place(docs: DataFrame, shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (0-based), by a broadcast lookup."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    docs = docs.drop("slot", "shard").withColumn("slot", slot(key, size))
    return docs.join(F.broadcast(table_frame(docs.sparkSession, names(shards), size)), "slot", "left").select(*docs.columns, "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 1) -> None:
    """One folder per shard below ``path``; a shard's rows are dealt over ``files_per_shard`` files."""
    placed = place(docs, shards).withColumn("_deal", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard)))
    placed.repartition("shard", "_deal").drop("_deal", "slot").write.partitionBy("shard").parquet(path)
