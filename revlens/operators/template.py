"""Labelling template (S14): low reviews in template order with ids and blank label columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.functions.dates import dashboard_time, format_review_date
from revlens.functions.size import extract_size
from revlens.operators.sequence import review_ids
from revlens.schema import ORD, display_columns

TEMPLATE_COLUMNS = ["review_id", "model_id", "model_name", "size", "channel", "site", "overall_rating",
                    "rating", "review_date", "title", "review_text", "issue_summary",
                    "primary_label", "secondary_label", "reason_label"]


def template_order():
    """O2: model asc, size asc, date desc (undated last), then row order."""
    return [F.col("model_id").asc(), F.col("size").asc(), F.col("_sort_date").desc_nulls_last(), F.col(ORD).asc()]


def labeling_template(low: DataFrame) -> DataFrame:
    t = (low.withColumn("size", extract_size())
         .withColumn("_sort_date", dashboard_time("review_date"))
         .withColumn("review_date", format_review_date("review_date"))
         .withColumn("overall_rating", F.coalesce(F.col("overall_rating"), F.lit(""))))
    t = review_ids(t, template_order(), wide=True).drop("_sort_date")
    for c in ("primary_label", "secondary_label", "reason_label"):
        t = t.withColumn(c, F.lit(""))
    return display_columns(t, [ORD, *TEMPLATE_COLUMNS])  # P14: wanted columns that exist, in order
