"""Consecutive numbering without a single-partition window.

``row_number()`` over a window with no partition (global ids) runs in one
task, and over ``partitionBy(model)`` it puts a hot model in one task.  Here
rows are range-sorted (Spark samples the keys, so a hot group is split over
many partitions), each row gets its position inside its Spark partition, the
sorted rows are materialised with ``checkpoint()`` so both uses below see the
same positions, and a small table of per-(partition, group) counts gives each
slice its offset.  That table has at most #partitions + #groups rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from revlens.session import materialize

_POS_BITS = 33  # monotonically_increasing_id = partition id << 33 | position


def sequence(df: DataFrame, order_cols, part_cols=(), name: str = "seq", carry=None) -> DataFrame:
    """Adds ``name`` = 1..n within each ``part_cols`` group following ``order_cols``.

    ``order_cols`` must give a total order (end with a unique column).  With ``carry`` only these
    columns, the group and ``name`` are returned, and only they and the order keys are sorted."""
    part_cols = list(part_cols)
    kept = list(df.columns) if carry is None else list(dict.fromkeys([*carry, *part_cols]))
    sort_keys = [F.col(c).asc_nulls_first() for c in part_cols] + list(order_cols)
    placed = materialize(df.orderBy(*sort_keys)
                         .withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
                         .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
                         .drop("_mid").select(*kept, "_pid", "_pos"))
    # one row per (partition, group) slice: where it starts and how many rows it has
    slices = placed.groupBy("_pid", *part_cols).agg(F.min("_pos").alias("_start"),
                                                     F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part_cols).orderBy("_pid") if part_cols else Window.orderBy("_pid")
    slices = slices.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    renamed = slices.select(*[F.col(c).alias("_s_" + c) for c in ["_pid", *part_cols]], "_start", "_before")
    cond = [placed["_pid"] == renamed["_s__pid"]] + [placed[c].eqNullSafe(renamed["_s_" + c]) for c in part_cols]
    joined = placed.join(renamed, cond).drop(*["_s_" + c for c in ["_pid", *part_cols]])
    return (joined.withColumn(name, (F.col("_before") + F.col("_pos") - F.col("_start") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_start", "_before"))


def sequence_wide(df: DataFrame, order_cols, part_cols=(), name: str = "seq") -> DataFrame:
    """``sequence`` for rows with long texts: the rows are written once with a row number, the number and
    the order keys alone are range-sorted, and the positions are joined back."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    numbers = sequence(rows, order_cols, part_cols, name, carry=["_row"]).select("_row", name)
    return rows.join(numbers, "_row").drop("_row")


def review_ids(df: DataFrame, order_cols, prefix: str = "R", width: int = 4, wide: bool = False) -> DataFrame:
    """Global ids R0001, R0002 ... in the given order (at least ``width`` digits); ``wide`` rows hold
    long texts."""
    seq = (sequence_wide if wide else sequence)(df, order_cols, (), "_rid")
    return seq.withColumn("review_id", F.format_string(f"{prefix}%0{width}d", F.col("_rid"))).drop("_rid")


def batch_ids(df: DataFrame, order_cols, size: int, part_cols=()) -> DataFrame:
    """Fixed-size ordered batches: batch = (position - 1) / size."""
    seq = sequence(df, order_cols, part_cols, "_bseq")
    return (seq.withColumn("batch_id", F.floor((F.col("_bseq") - 1) / size).cast("bigint"))
            .withColumn("batch_pos", ((F.col("_bseq") - 1) % size).cast("int"))
            .drop("_bseq"))
