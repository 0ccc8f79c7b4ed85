"""Rows picked by a large set of ids, with a small broadcast ahead of the shuffle.

The ids are hashed into a bitmap of BITS bits (4 MB, whatever the data), which is built by
a Spark aggregate and broadcast.  Rows whose bit is not set are surely not in the set and
never shuffled; the others meet the ids in an exact join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 25


def flagged(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether the bit of ``key`` is set for the one column of ``ids``."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bits = (ids.toDF("id").where("id is not null").select(place("id").alias("v"))
            .groupBy(F.bitmap_bucket_number("v").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits")))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    # BITS / 32768 rows of 4 KB at most
    return (df.withColumn("_bucket", F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(place(key)))).join(F.broadcast(bits), "_bucket", "left")
            .withColumn("_at", at).withColumn("_byte", byte).withColumn("_maybe", F.coalesce(bit, F.lit(False)))
            .drop("_bucket", "_bits", "_at", "_byte"))


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``ids`` (which may repeat)."""
    exact = ids.toDF("_id").distinct()
    return flagged(df, key, ids).where("_maybe").drop("_maybe").join(exact, F.col(key) == F.col("_id"), "left_semi")


def outside(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``; null keys stay."""
    exact = ids.toDF("_id").distinct()
    marked = flagged(df, key, ids)
    surely = marked.where("not _maybe").drop("_maybe")
    return surely.unionByName(marked.where("_maybe").drop("_maybe").join(exact, F.col(key) == F.col("_id"), "left_anti"))
