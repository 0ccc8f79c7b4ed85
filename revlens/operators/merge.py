"""Cumulative review table: union, new rows, merge.

The stored table is never rewritten in place: a merge writes a new version
folder and returns its path; readers keep reading the old one until they
switch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from revlens.operators.dedupe import keep_first, new_reviews
from revlens.schema import DEDUPE_KEYS, ORD

MERGE_ORDER = "_merge_ord"


def union_reviews(*parts: DataFrame) -> DataFrame:
    """Union by column name; columns missing in a part are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(existing: DataFrame, incoming: DataFrame, keys=DEDUPE_KEYS) -> DataFrame:
    """Keep-first over existing rows followed by incoming rows (existing wins ties)."""
    ex = existing.withColumn(MERGE_ORDER, F.struct(F.lit(0).alias("src"), F.col(ORD).alias("ord")))
    inc = incoming.withColumn(MERGE_ORDER, F.struct(F.lit(1).alias("src"), F.col(ORD).alias("ord")))
    both = union_reviews(ex, inc)
    return keep_first(both, keys, order=MERGE_ORDER).drop(MERGE_ORDER)


def merge_stats(existing: DataFrame, incoming: DataFrame, keys=DEDUPE_KEYS) -> DataFrame:
    """A16 for a merge: existing, added (= total - existing; negative when the stored table
    held duplicates) and total - one aggregate over both row sets."""
    tagged = (existing.select(F.lit(1).alias("_e"), F.lit(0).alias("_t"))
              .unionByName(merged(existing, incoming, keys).select(F.lit(0).alias("_e"), F.lit(1).alias("_t"))))
    row = tagged.agg(F.sum("_e").alias("e"), F.sum("_t").alias("t"))
    return row.select(F.coalesce("e", F.lit(0)).cast("bigint").alias("existing_count"),
                      (F.coalesce("t", F.lit(0)) - F.coalesce("e", F.lit(0))).cast("bigint").alias("added_count"),
                      F.coalesce("t", F.lit(0)).cast("bigint").alias("total_count"))
