"""Mixing sources to target weights: capped water-filling and seeded repetitions.

The size of a document is its number of ``[^\\x20\\x09-\\x0D]+`` (null: 0).  Sources, in code
point order with null last, have the weights 5, 2, 1, 5, 2, 1, ...  Their targets share
the sum of all sizes by weight; a target stops at MAX_EPOCHS times the size of its source
and the excess is shared again by weight.  In closed form: the target is the smaller of
weight x level and the cap, where the level is found by walking the sources in the order
of cap / weight.

Documents of a source are ordered by a seeded hash, in BINS bins.  With epochs = target /
source size, every document is taken floor(epochs) times, and once more in the first bins
until the fractional rest is filled; the bin on the boundary takes the same part of each
of its documents.  So the words taken meet the target up to rounding, no source is sorted
or collected, and a source that holds a third of all rows is BINS pre-aggregated rows.
Only DataFrame functions run; the window functions see one row per source, or BINS rows
per source.

Defined results: null and empty texts have size 0 and are taken with 0 words; a source of
size 0 has target 0; with no words at all every target is 0.  A null source is a source of
its own.  Repeated rows are rows like any others (they share a bin); a null doc_id is
allowed.  Extra columns stay; clashing names are replaced.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.store import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BINS = 4096
SEED = "mix-1"
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    cap = (F.col("source_size") * MAX_EPOCHS).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose cap lies above its level and all after it are not clamped
    rows = rows.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole))
    target = F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final.ratio")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final.level")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def shares(narrow: DataFrame) -> DataFrame:
    """From rows (source, size, bin), one row per source: (s, source_size, target, whole,
    edge, part): whole repetitions, the bin on the boundary and the part taken of it."""
    bins = stored(narrow.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    sources = targets(bins.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.least(F.floor(epochs + 1e-12), F.lit(MAX_EPOCHS)).cast("long"))
    sources = sources.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    sources = sources.withColumnRenamed("source", "s")
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = bins.withColumn("below", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    part = F.when(F.col("at.words") > 0, F.least(F.lit(1.0), (F.col("rest") - F.col("at.below")) / F.col("at.words"))).otherwise(F.lit(0.0))
    edges = (filled.join(sources, F.col("source").eqNullSafe(F.col("s"))).where("below <= rest")
             .groupBy("s", "source_size", "target", "whole", "rest").agg(F.max(F.struct("bin", "below", "words")).alias("at")))
    return stored(edges.select("s", "source_size", "target", "whole", F.col("at.bin").alias("edge"), part.alias("part")), "shares")


def _sized(docs: DataFrame, *keep) -> DataFrame:
    return docs.select(*keep, F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"), _bin().alias("bin"))


def _bin() -> Column:
    """0..BINS - 1 from the first three hex digits of an MD5 of seed and doc_id (null: text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), key).cast("binary")), 1, 3), 16, 10).cast("int")


def _extra() -> Column:
    """Part of a repetition beyond the whole ones: 1, the boundary part, or 0."""
    return F.when(F.col("bin") < F.col("edge"), F.lit(1.0)).when(F.col("bin") == F.col("edge"), F.col("part")).otherwise(F.lit(0.0))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): words taken from each row of
    ``docs``, and the same as a number of whole rows (the boundary part is rounded)."""
    narrow = stored(_sized(docs, "doc_id"), "sizes")
    taken = F.col("whole") * F.col("size") + F.round(_extra() * F.col("size")).cast("long")
    return narrow.join(shares(narrow), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.least(taken, F.col("size") * MAX_EPOCHS).cast("long").alias("taken"), (F.col("whole") + F.round(_extra())).cast("long").alias("copies"))


def repeat(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, in whole rows.

    The per-source table is broadcast when it has at most BROADCAST_SOURCES rows; beyond
    that the copies are joined by doc_id, which no source makes hot."""
    per_source = shares(stored(_sized(docs), "sizes"))
    copies = (F.col("whole") + F.round(_extra())).cast("int")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id"), _bin().alias("bin"))
    if per_source.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("s"))).select("row", copies.alias("copies"))
    else:
        many = (rows.select("source", "doc_id", "bin").distinct().join(per_source, F.col("source").eqNullSafe(F.col("s")))
                .select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("bin").alias("b"), copies.alias("copies")))
        out = rows.join(many, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("bin") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
