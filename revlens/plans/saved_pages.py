"""Saved-pages job (X7): captured pages per model -> de-duplicated reviews per model.

S6 reads the pages, they are put in natural file-name order (O4), a page's reviews are
those of its JSON if it has any and else those of its markup, W2 keeps the first
occurrence of a record across the pages of a model, and S8 writes one folder per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.functions.markup import natural_key
from revlens.operators.dedupe import keep_first_by
from revlens.operators.embedded import embedded_json_reviews, overall_rating, stored_scripts
from revlens.operators.extract import extract_reviews, source_precedence
from revlens.session import written
from revlens.sources.reviews import read_captured_pages

FIELDS = ["rating", "title", "review_text", "review_date", "author", "verified"]


def page_record_key() -> dict:
    """W2 key (variant A): rating, lower title, lower body (the whole of it), date, lower author."""
    s = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return {"rating": s("rating"), "title": F.lower(s("title")), "body": F.lower(s("review_text")),
            "date": s("review_date"), "author": F.lower(s("author"))}


def block_record_key() -> dict:
    """W2 key (variant B): the block id when there is one, else author, date, rating, title
    and the whole body."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    fallback = F.concat_ws("|", s("author"), s("review_date"), s("rating"), s("title"), F.trim(s("review_text")))
    return {"k": F.when(F.col("block_id").isNotNull(), F.concat(F.lit("id:"), F.col("block_id"))).otherwise(fallback)}


def pages_to_reviews(pages: DataFrame) -> DataFrame:
    """X7 on a table (page_id, model_id, file_name, url, html, profile)."""
    pages = written(pages.withColumn("page_key", natural_key("file_name")), "saved-pages")
    scripts = stored_scripts(pages)
    found = (embedded_json_reviews(pages, scripts).select("page_id", F.concat(F.array(F.col("script_no")), "item_place").alias("pos"), *FIELDS).withColumn("source_rank", F.lit(0))
             .unionByName(extract_reviews(pages).select("page_id", F.array("block_no").alias("pos"), *FIELDS).withColumn("source_rank", F.lit(1))))
    found = written(found, "page-reviews")  # counted and then joined: pages are parsed once
    meta = pages.select("page_id", "model_id", "page_key", "url").join(overall_rating(pages, scripts=scripts), "page_id")
    recs = source_precedence(found, ["page_id"]).join(meta, "page_id").withColumn("review_ord", F.struct("page_key", "page_id", "pos"))
    firsts = keep_first_by(recs.withColumn("_m", F.col("model_id")), {"m": F.col("_m"), **page_record_key()})
    return firsts.drop("_m", "source_rank").withColumnRenamed("url", "source_url")


def saved_pages_reviews(spark: SparkSession, folder: str, profile: str = "walmart") -> DataFrame:
    pages = read_captured_pages(spark, folder)
    return pages_to_reviews(pages.withColumn("page_id", F.xxhash64("path")).withColumn("profile", F.lit(profile)).withColumnRenamed("path", "url"))
