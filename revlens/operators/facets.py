"""Dashboard tables.

The dashboard's page state becomes function arguments; every table is one
grouped aggregate over the filtered reviews.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from revlens.functions.dates import clean_review_date, iso_week_label, parse_date_text
from revlens.functions.ratings import parse_rating_0_5, round_share, safe_ratio
from revlens.session import materialize

TEXT_COLUMNS = ["model_id", "model_name", "size", "channel", "site", "title", "review_text", "author"]


def dashboard_reviews(reviews: DataFrame) -> DataFrame:
    """Dashboard load: 0..5 rating, date after the last 'on ', ISO week, text NULL -> ''."""
    # the cleaned date text is its own column, so the lenient parse (eight formats)
    # refers to it instead of repeating the cleaning expression in the plan
    out = (reviews.withColumn("rating_num", parse_rating_0_5("rating"))
           .withColumn("_date_text", clean_review_date("review_date"))
           .withColumn("review_day", parse_date_text(F.col("_date_text")).cast("date"))
           .drop("_date_text"))
    out = out.withColumn("week", iso_week_label("review_day"))
    for c in TEXT_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def facet_filter(df: DataFrame, models=None, channels=None, ratings=None,
                 start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """IN-lists per facet (empty/None = no filter) and a date range [start, end + 1 day).

    Selecting values drops rows whose facet is NULL, as the dashboard does."""
    if models:
        df = df.filter(F.col("model_id").isin(list(models)))
    if channels:
        df = df.filter(F.col("channel").isin(list(channels)))
    if ratings:
        df = df.filter(F.col("rating_num").isin([float(r) for r in ratings]))
    if start is not None and end is not None:
        df = df.filter((F.col("review_day") >= F.lit(start)) & (F.col("review_day") < F.date_add(F.lit(end), 1)))
    return df


def semi_join_models(analysis: DataFrame, filtered: DataFrame) -> DataFrame:
    """Analysis rows of models present in the filtered reviews (left semi join)."""
    return analysis.join(filtered.select("model_id"), "model_id", "left_semi")


def model_channel_rollup(df: DataFrame) -> DataFrame:
    """A8 in long form with all margins: counts per (model, channel), per model, per channel and over
    all.  ``margin`` is 0 for a cell, 1 for a model's total (no channel), 2 for a channel's total
    (no model), 3 for the grand total.  Any number of channels; one aggregate."""
    counted = df.cube("model_id", "channel").agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews"), F.grouping_id("model_id", "channel").cast("int").alias("margin"))
    return counted.select("model_id", "channel", "margin", "n_reviews")


def model_channel_pivot(df: DataFrame, channels=None) -> DataFrame:
    """Model x channel review counts, 0-filled, with the row total; one column for every
    channel of the list ``channels``, or without a list for every one that occurs.  Rows are
    counted once per (model, channel); names and pivot come from these counts.  Unknown sites are
    channels of their own, so give the list, or use ``model_channel_rollup``, where they
    may be many."""
    counts = materialize(df.groupBy("model_id", "channel").agg(F.count(F.lit(1)).alias("n")))
    channels = channels or sorted(r["channel"] for r in counts.select("channel").distinct().collect())
    cells = [F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in channels]
    return counts.groupBy("model_id").agg(*cells, F.sum("n").cast("bigint").alias("total"))


def weekly_trend(df: DataFrame, models=None) -> DataFrame:
    """Reviews per ISO week and model (long form; undated rows dropped)."""
    dated = df.filter(F.col("review_day").isNotNull())  # the rows whose week label is not ''
    if models:
        dated = dated.filter(F.col("model_id").isin(list(models)))
    return dated.groupBy("week", "model_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews"))


def issue_share_dashboard(summary: DataFrame, label="primary", count="n_issues") -> DataFrame:
    """Summed counts per (model, category) with the share in percent (0 when the total is 0)."""
    n = F.coalesce(F.col(count).cast("string").try_cast("double"), F.lit(0.0))
    per = summary.groupBy("model_id", label).agg(F.sum(n).alias("n"))
    total = F.sum("n").over(Window.partitionBy("model_id"))
    return per.select("model_id", label, F.col("n").alias("n_issues"),
                      round_share(safe_ratio("n", total) * 100).alias("share_pct"))


def issue_top(summary: DataFrame, label="primary", count="n_issues") -> DataFrame:
    """Category totals over all models."""
    return summary.groupBy(label).agg(F.sum(count).cast("bigint").alias("n_issues"))


def kpis(filtered: DataFrame, detail: DataFrame) -> DataFrame:
    """Total, low, distinct models, distinct channels, classified low reviews (long form)."""
    # one row per (model, channel) holds all that is counted; models and channels follow from it
    per = materialize(filtered.groupBy("model_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating_num") <= 3).alias("low")))
    top = per.agg(F.sum("n").alias("total"),
                       F.sum("low").alias("low"),
                       F.count_distinct("model_id").alias("models"),
                       F.count_distinct("channel").alias("channels"))
    top = top.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kpi"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("value"))
        for k in ("total", "low", "models", "channels")])).alias("x")).select("x.*")
    done = semi_join_models(detail, per).agg(F.count(F.lit(1)).cast("bigint").alias("value")) \
        .select(F.lit("classified").alias("kpi"), "value")
    return top.unionByName(done)


SKETCH_BITS = 12  # 2**12 registers: a standard error of about 1.6 %


def weekly_sketches(df: DataFrame, column: str = "author") -> DataFrame:
    """A13, approximate: per week the reviews and a sketch of the distinct non-empty values of ``column``.
    The rows can be stored and merged with those of other runs."""
    dated = df.filter(F.col("review_day").isNotNull())
    return dated.groupBy("week").agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews"),
                                     F.hll_sketch_agg(F.nullif(F.col(column), F.lit("")), F.lit(SKETCH_BITS)).alias("sketch"))


def merge_sketches(*parts: DataFrame, by=()) -> DataFrame:
    """Stored sketch rows merged per ``by`` (all into one without): exact row counts, estimated
    distinct values.  No review is read again."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*by).agg(F.sum("n_reviews").cast("bigint").alias("n_reviews"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def facet_values(df: DataFrame) -> DataFrame:
    """Distinct values per facet (long form) plus the date bounds, from one pass: each row
    gives its facet values, and one aggregate keeps the distinct ones and the date bounds."""
    text = lambda c: F.col(c).cast("string")
    facets = F.array(F.struct(F.lit("model").alias("facet"), text("model_id").alias("value")), F.struct(F.lit("channel").alias("facet"), text("channel").alias("value")),
                     F.struct(F.lit("rating").alias("facet"), text("rating_num").alias("value")), F.struct(F.lit("date").alias("facet"), F.lit(None).cast("string").alias("value")))
    found = df.select("review_day", F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.min("review_day").alias("lo"), F.max("review_day").alias("hi"))
    bounds = F.array(F.struct(F.lit("date_min").alias("facet"), F.col("lo").cast("string").alias("value")), F.struct(F.lit("date_max").alias("facet"), F.col("hi").cast("string").alias("value")))
    own = F.array(F.struct(F.col("facet"), F.col("value")))
    kept = found.filter((F.col("facet") != "rating") | F.col("value").isNotNull())
    return kept.select(F.explode(F.when(F.col("facet") == "date", bounds).otherwise(own)).alias("x")).select("x.facet", "x.value")


def records_per_target(df: DataFrame) -> DataFrame:
    """Records per (model, site)."""
    return df.groupBy("model_id", "site").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"))
