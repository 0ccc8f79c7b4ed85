"""Filters on extracted review records (P9, P11, P12) and ordered distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.markup import url_param
from revlens.functions.ratings import normalize_rating_text
from revlens.functions.text import col_of, py_strip

# Texts that are only a badge, not a review.
BADGE_TEXTS = ["verified purchase", "walmart associate", "incentivized review", "received free product"]


def _blank(c) -> Column:
    return py_strip(F.coalesce(col_of(c), F.lit(""))) == ""


def has_content(df: DataFrame, body="review_text", title="title") -> DataFrame:
    """Keep records with a body or a title."""
    return df.filter(~(_blank(body) & _blank(title)))


def drop_badge_only(df: DataFrame, body="review_text", title="title", rating="rating",
                    author="author", date="review_date") -> DataFrame:
    """Drop records whose only text is a badge and that have no rating, author or date."""
    text = F.lower(py_strip(F.coalesce(F.nullif(col_of(body), F.lit("")), F.nullif(col_of(title), F.lit("")), F.lit(""))))
    badge = (text.isin(BADGE_TEXTS) & col_of(rating).isNull() & _blank(author) & _blank(date))
    return df.filter(~badge)


def rating_filter_match(df: DataFrame, url="source_url", rating="rating", param="ratings") -> DataFrame:
    """When the URL asks for one rating, drop records carrying another one (text compare of
    the normalised rating); records without a rating are kept."""
    wanted = url_param(url, param)
    got = F.nullif(normalize_rating_text(rating), F.lit(""))
    return df.filter(wanted.isNull() | got.isNull() | (got == wanted))


def ordered_distinct(arr) -> Column:
    """Distinct values keeping the first position (array_distinct keeps order)."""
    return F.array_distinct(F.filter(col_of(arr), lambda x: x.isNotNull()))
