"""Report tables.

Every table is one grouped aggregate.  Shares are computed on the aggregated
rows (one row per model x category), so the window or join that brings the
denominator is over a table whose size is bounded by models x categories,
never over raw reviews.  "First" values use ``min(struct(review_ord, value))``,
which aggregates partially on the map side (no per-group row lists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.functions.dates import dashboard_time, parse_date_text
from revlens.functions.ratings import parse_rating, round_share, safe_ratio
from revlens.functions.size import ALL_SIZES, UNKNOWN_SIZE, extract_size
from revlens.functions.text import col_of, py_strip
from revlens.schema import ORD


def first_value(value, order=ORD, cond=None) -> Column:
    """Value of the row with the smallest ``order`` among rows where ``cond`` holds."""
    v = col_of(value)
    cond = v.isNotNull() if cond is None else cond
    return F.min(F.when(cond, F.struct(col_of(order).alias("o"), v.alias("v"))))["v"]


def first_non_empty(c, order=ORD) -> Column:
    """A3: first trimmed non-blank value in row order."""
    t = py_strip(col_of(c).cast("string"))
    return first_value(t, order, t != "")


def keywords_map(tax: DataFrame, n: int = 8):
    """Category -> first n phrases of its first occurrence, as one constant map
    (looked up in the projection, no join)."""
    from revlens.operators.classify import constant, taxonomy_rows
    rows = taxonomy_rows(tax)
    first_ord = {}
    for r in rows:
        first_ord.setdefault(r["category"], r["cat_ord"])
        first_ord[r["category"]] = min(first_ord[r["category"]], r["cat_ord"])
    words: dict = {}
    for r in sorted(rows, key=lambda r: r["phrase_ord"]):
        if r["cat_ord"] == first_ord[r["category"]]:
            words.setdefault(r["category"], []).append(r["phrase"])
    return constant({k: ", ".join(v[:n]) for k, v in words.items()}, "map<string,string>")


def issue_counts(low: DataFrame, tax: DataFrame, label="primary") -> DataFrame:
    """A1 (flagship): per model, count and share of low reviews per category, with keywords.

    ``issue_rank`` orders by count desc, ties by first appearance."""
    counts = (low.filter(F.col("model_id").isNotNull())
              .groupBy("model_id", label)
              .agg(F.count(F.lit(1)).alias("n_issues"), F.min(ORD).alias("_first")))
    per_model = Window.partitionBy("model_id")
    ranked = Window.partitionBy("model_id").orderBy(F.col("n_issues").desc(), F.col("_first"))
    kw = keywords_map(tax)
    return (counts
            .withColumn("share", round_share(safe_ratio("n_issues", F.sum("n_issues").over(per_model))))
            .withColumn("issue_rank", F.row_number().over(ranked).cast("bigint"))
            .select("model_id", label, F.col("n_issues").cast("bigint").alias("n_issues"), "share",
                    F.coalesce(F.try_element_at(kw, F.col(label)), F.lit("")).alias("keywords"), "issue_rank"))


def top_issues_k(low: DataFrame, k: int, label="primary") -> DataFrame:
    """O3: the k most frequent categories over all models (count desc, first seen) - a top-k report."""
    counts = low.groupBy(label).agg(F.count(F.lit(1)).alias("n_issues"), F.min(ORD).alias("_first"))
    return counts.orderBy(F.col("n_issues").desc(), "_first").limit(k).drop("_first")


def model_header(rated: DataFrame) -> DataFrame:
    """Per model the total of rated reviews and the low (<= 3 stars) count."""
    return (rated.filter(F.col("model_id").isNotNull())
            .groupBy("model_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("total_reviews"),
                 F.count_if(F.col("rating_num") <= 3).cast("bigint").alias("low_reviews")))


def channel_metrics(rated: DataFrame) -> DataFrame:
    """A2: AMZ one row per model (size = all), BBY one row per model and size; other channels omitted."""
    ch = F.upper(F.coalesce(F.col("channel"), F.lit("")))
    size_txt = extract_size(texts=[c for c in ("title", "review_text") if c in rated.columns])
    rows = (rated.filter(F.col("model_id").isNotNull())
            .withColumn("_ch", ch)
            .filter(F.col("_ch").isin("AMZ", "BBY"))
            .withColumn("_size", F.when(F.col("_ch") == "AMZ", F.lit(ALL_SIZES))
                        .otherwise(F.coalesce(F.nullif(size_txt, F.lit("")), F.lit(UNKNOWN_SIZE))))
            .withColumn("_overall", parse_rating("overall_rating")))
    name = F.coalesce(first_non_empty("model_name"), first_non_empty("model_id"), F.lit(""))
    rating = F.coalesce(first_value("_overall"), F.avg("rating_num"))
    return (rows.groupBy("model_id", F.col("_ch").alias("channel"), F.col("_size").alias("size"))
            .agg(name.alias("model_name"), F.bround(rating, 1).alias("avg_rating"),
                 F.count(F.lit(1)).cast("bigint").alias("n_reviews")))


def overview(labeled: DataFrame, label="primary_label") -> DataFrame:
    """A5: by (model, size): count per primary label, share of the (model, size) total, total."""
    base = labeled.filter(F.col("model_id").isNotNull())
    groups = base.groupBy("model_id", "size").agg(
        F.coalesce(first_non_empty("model_name"), F.lit("")).alias("model_name"),
        F.count(F.lit(1)).alias("total"))
    counts = base.groupBy("model_id", "size", label).agg(F.count(F.lit(1)).alias("n_issues"))
    return (counts.join(groups, ["model_id", "size"])
            .select("model_id", "model_name", "size", F.col(label).alias("primary"),
                    F.col("n_issues").cast("bigint").alias("n_issues"),
                    round_share(safe_ratio("n_issues", "total")).alias("share"),
                    F.col("total").cast("bigint").alias("total")))


def _model_totals(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("model_id").agg(F.count(F.lit(1)).alias("total"))


def primary_summary(labeled: DataFrame, label="primary_label") -> DataFrame:
    """By (model, size, primary), share of the whole model's total."""
    base = labeled.filter(F.col("model_id").isNotNull())
    counts = base.groupBy("model_id", "size", label).agg(F.count(F.lit(1)).alias("n_issues"))
    return (counts.join(_model_totals(base), "model_id")
            .select("model_id", "size", F.col(label).alias("primary"),
                    F.col("n_issues").cast("bigint").alias("n_issues"),
                    round_share(safe_ratio("n_issues", "total")).alias("share"),
                    F.col("total").cast("bigint").alias("total")))


def secondary_summary(labeled: DataFrame, label="primary_label", label2="secondary_label") -> DataFrame:
    """By (model, size, primary, secondary), share of the model total."""
    base = labeled.filter(F.col("model_id").isNotNull())
    counts = base.groupBy("model_id", "size", label, label2).agg(F.count(F.lit(1)).alias("n_issues"))
    return (counts.join(_model_totals(base), "model_id")
            .select("model_id", "size", F.col(label).alias("primary"), F.col(label2).alias("secondary"),
                    F.col("n_issues").cast("bigint").alias("n_issues"),
                    round_share(safe_ratio("n_issues", "total")).alias("share")))


def newest_first_key(date_col="review_date", parser=dashboard_time):
    """O1: sort key list - parsed date desc with undated last, then row order (stable).  Dates are
    read after the last "on" (F22); ``parse_review_date`` (the first "on", F20) is the other reading."""
    return [parser(date_col).desc_nulls_last(), F.col(ORD).asc()]


def detail_seq(df: DataFrame, date_col="review_date", parser=dashboard_time, part="model_id") -> DataFrame:
    """1..n per model, newest first.  Numbered by the range-sorted ``sequence`` job,
    not a window per model, so a model holding most rows is still split over many tasks."""
    from revlens.operators.sequence import sequence
    return sequence(df, newest_first_key(date_col, parser), [part], "seq")


def labeled_detail_seq(labeled: DataFrame) -> DataFrame:
    """W4 as used on labelled reviews: the date is the already formatted text."""
    return detail_seq(labeled, "review_date", lambda c: parse_date_text(F.col(c)))
