"""Keep-first de-duplication.

Keep-first means: among rows whose normalised key is equal, keep the one with
the smallest ``review_ord``.  ``dropDuplicates`` keeps an arbitrary row, so it
is not used.

Plan: the normalised key columns are hashed (SHA-256, 32 bytes) and the smallest
``review_ord`` per digest is found by a hash aggregate on one long.  It runs
partially on the map side, so a key that holds a large share of all rows (one
review scraped many times) is collapsed before the shuffle and never lands whole
in one task.  The rows themselves are then picked by a semi join on the ordinal,
which is unique: texts are neither sorted nor aggregated, and a consumer that
reads few columns passes ``carry=[...]`` so that only those meet the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.text import norm_key
from revlens.schema import DEDUPE_KEYS, ORD

KEY = "_dedupe_key"


def _joined(values) -> Column:
    """Injective join of texts: NUL inside a value is doubled, values are separated by
    NUL + ';' (so the parts can always be told apart), each value referenced once."""
    return F.concat_ws("\u0000;", *[F.replace(F.coalesce(v, F.lit("")), F.lit("\u0000"), F.lit("\u0000\u0000"))
                                    for v in values])


def key_digest(cols, normalize=norm_key) -> Column:
    """SHA-256 (32 bytes) of the normalised key columns."""
    return F.unhex(F.sha2(_joined([normalize(c) for c in cols]), 256))


def with_key(df: DataFrame, keys=DEDUPE_KEYS, normalize=norm_key) -> DataFrame:
    return df.withColumn(KEY, key_digest([k for k in keys], normalize))


def keep_first(df: DataFrame, keys=DEDUPE_KEYS, order=ORD, normalize=norm_key, carry=None) -> DataFrame:
    """First row (smallest ``order``) per normalised key.  Returns ``order`` and the
    ``carry`` columns (default: all columns, in their order)."""
    cols = [order] + [c for c in carry if c != order] if carry else list(df.columns)
    first = df.select(order, key_digest(list(keys), normalize).alias(KEY)).groupBy(KEY).agg(F.min(order).alias("_first"))
    return df.select(*cols).join(first.select(F.col("_first").alias(order)), order, "left_semi").select(*cols)


def keep_first_by(df: DataFrame, key_exprs: dict, order=ORD) -> DataFrame:
    """Keep-first on arbitrary key expressions (name -> Column)."""
    cols = [c for c in df.columns if c != order]
    keyed = df.withColumn(KEY, F.unhex(F.sha2(_joined([e.cast("string") for e in key_exprs.values()]), 256)))
    first = keyed.groupBy(KEY).agg(F.min(F.struct(order, *cols)).alias("_r"))
    return first.select(*[F.col("_r." + c).alias(c) for c in df.columns])


def dedupe_stats(raw: DataFrame, keys=DEDUPE_KEYS, normalize=norm_key) -> DataFrame:
    """Original / deduped / removed counts in one pass over the keys."""
    per_key = with_key(raw.select(*keys), keys, normalize).groupBy(KEY).count()
    return per_key.agg(F.sum("count").cast("bigint").alias("original_count"),
                       F.count(F.lit(1)).cast("bigint").alias("deduped_count")) \
        .withColumn("removed_count", F.col("original_count") - F.col("deduped_count"))


def new_reviews(incoming: DataFrame, existing: DataFrame, keys=DEDUPE_KEYS) -> DataFrame:
    """Incoming rows (first per key) whose key is not stored yet (left anti join on the digest)."""
    first = keep_first(incoming, keys)
    return (with_key(first, keys)
            .join(with_key(existing.select(*keys), keys).select(KEY), KEY, "left_anti")
            .drop(KEY))
