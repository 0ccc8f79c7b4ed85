"""Stored dedupe keys in partitions by digest prefix.

The first bits of a SHA-256 digest deal the keys evenly over 2**bits partition folders.  A batch
that holds few keys hits few prefixes, at most 2**bits small numbers; a filter on the partition
column by them makes Spark skip the other folders, so the reading follows the batch and not
the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.session import materialize

BITS = 6  # more for a long history: a folder should hold some hundred MB of rows
PREFIX = "_prefix"


def prefix(key: Column, bits: int = BITS) -> Column:
    """The first ``bits`` (16 at most) bits of a binary digest."""
    return F.shiftright(F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int"), 16 - bits)


def unseen(batch: DataFrame, stored: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows of ``batch`` whose digest ``key`` is not in ``stored`` (key, PREFIX), a table written in partitions
    by PREFIX.  Only the partitions of the batch's prefixes are read."""
    rows = materialize(batch.withColumn(PREFIX, prefix(F.col(key), bits)))  # read for its prefixes and for its rows
    hit = [r[0] for r in rows.select(PREFIX).distinct().collect()]  # at most 2**bits numbers
    return rows.join(stored.where(F.col(PREFIX).isin(hit)).select(key), key, "left_anti")
