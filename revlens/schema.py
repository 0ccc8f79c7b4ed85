"""Canonical review schema and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The 14 export columns in their order, and the dedupe key.
REVIEW_COLUMNS = [
    "model_id", "model_name", "size", "channel", "site", "source_url",
    "overall_rating", "rating", "title", "review_text", "review_date",
    "author", "verified", "scraped_at",
]
DEDUPE_KEYS = ["model_id", "channel", "site", "title", "review_text", "review_date", "author"]
ANALYSIS_REQUIRED = {
    "model_id", "model_name", "channel", "site", "source_url", "rating",
    "title", "review_text", "review_date", "author",
}
LABELED_REQUIRED = {
    "review_id", "model_id", "model_name", "channel", "site", "rating",
    "review_date", "title", "review_text", "issue_summary",
    "primary_label", "secondary_label",
}

ORD = "review_ord"


class MissingColumns(ValueError):
    pass


def has_columns(df: DataFrame, required) -> bool:
    """Lenient subset test (P13): sources lacking a column are skipped."""
    return set(required).issubset(df.columns)


def require_columns(df: DataFrame, required) -> DataFrame:
    """Strict subset test (P13): raise with the sorted list of what is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumns(f"Missing expected columns: {missing}")
    return df


def normalize_schema(df: DataFrame, columns=REVIEW_COLUMNS, keep=(ORD,)) -> DataFrame:
    """Add missing columns as '', drop extras, fix the order."""
    cols = [F.col(k) for k in keep if k in df.columns]
    for c in columns:
        cols.append(F.col(c) if c in df.columns else F.lit("").alias(c))
    return df.select(*cols)


def record_to_row(df: DataFrame, columns=REVIEW_COLUMNS, keep=(ORD,)) -> DataFrame:
    """Export row - every text column with NULL replaced by ''."""
    cols = [F.col(k) for k in keep if k in df.columns]
    for c in columns:
        cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns
                    else F.lit("").alias(c))
    return df.select(*cols)


def display_columns(df: DataFrame, wanted) -> DataFrame:
    """Ordered projection of the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])
