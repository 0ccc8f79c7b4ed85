"""Composed analyses: review analysis (C6) and labelled summary.

One lazy plan per analysis; the caller decides what to persist.  Filters that
make later work smaller (rated only, <= 3 stars) come before classification,
and dedupe comes before everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens import fixtures
from revlens.functions.dates import format_date_or_raw
from revlens.functions.ratings import parse_rating
from revlens.functions.size import extract_size
from revlens.functions.text import issue_summary, py_strip
from revlens.operators.classify import classify_keyword
from revlens.operators.dedupe import keep_first


@dataclass
class Analysis:
    raw: DataFrame
    deduped: DataFrame
    rated: DataFrame       # deduped rows with a parsable rating (+ rating_num)
    low: DataFrame         # rated rows with rating_num <= 3 (+ issue_summary)
    taxonomy: DataFrame


def rate(deduped: DataFrame) -> DataFrame:
    """F8 + P5: numeric rating; rows without one are dropped."""
    return deduped.withColumn("rating_num", parse_rating("rating")).filter(F.col("rating_num").isNotNull())


def low_reviews(rated: DataFrame) -> DataFrame:
    """P4 + F5: <= 3 stars, with the issue summary."""
    return rated.filter(F.col("rating_num") <= 3).withColumn("issue_summary", issue_summary())


def analysis(spark: SparkSession, sf_dir: str, tax: DataFrame | None = None) -> Analysis:
    raw = fixtures.reviews(spark, sf_dir)
    deduped = keep_first(raw)
    rated = rate(deduped)
    low = low_reviews(rated)
    tax = tax if tax is not None else fixtures.taxonomy(spark)
    return Analysis(raw, deduped, rated, low, tax)


def classified(a: Analysis) -> DataFrame:
    """C6 classification step (keyword mode): primary, secondary, reason."""
    return classify_keyword(a.low, a.taxonomy).withColumn("reason", F.lit(""))


def labeled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 input: low reviews with human labels (labels.quality -> primary, labels.toxic -> secondary).

    Mirrors S4: blank labels become 'Other', size is extracted, the date is formatted (F24)."""
    a = analysis(spark, sf_dir)
    labels = fixtures.table(spark, sf_dir, "labels").select(
        (F.col("doc_id") * 2).alias("review_ord"),
        F.col("quality").cast("string").alias("_p"), F.col("toxic").cast("string").alias("_s"))
    blank_other = lambda c: F.coalesce(F.nullif(py_strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")), F.lit("Other"))
    return (a.low.join(labels, "review_ord")
            .withColumn("primary_label", blank_other("_p"))
            .withColumn("secondary_label", blank_other("_s"))
            .withColumn("size", extract_size())
            .withColumn("review_date", format_date_or_raw("review_date"))
            .drop("_p", "_s"))
