"""Rating parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlens.functions.text import col_of

__all__ = [
    "NUMBER", "parse_rating", "parse_rating_0_5", "normalize_rating_text",
    "overall_rating_text", "rating_label", "round_share", "safe_ratio", "clamp",
    "format_g", "NO_RATING_LABEL",
]

NUMBER = r"\d+(?:\.\d+)?"
# Fixed value: label for a missing rating.
NO_RATING_LABEL = "无评分"


def _first_number(c) -> Column:
    return F.nullif(F.regexp_extract(col_of(c).cast("string"), NUMBER, 0), F.lit(""))


def parse_rating(c) -> Column:
    """F8: first number in the text as double, unbounded; NULL when none."""
    return _first_number(c).try_cast("double")


def parse_rating_0_5(c) -> Column:
    """F8 limited to 0..5."""
    v = parse_rating(c)
    return F.when(v.between(0, 5), v)


def normalize_rating_text(c) -> Column:
    """first number as text, else the stripped raw text."""
    return F.coalesce(_first_number(c), F.trim(col_of(c).cast("string")))


def format_g(v) -> Column:
    """Python's '%g' for values with at most 6 significant digits: no trailing zeros."""
    s = F.format_string("%.6g", v)
    # drop trailing zeros of a fraction, then a bare trailing dot
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def overall_rating_text(c) -> Column:
    """number before an optional 'out of' and 5, else the first number; kept in 0..5, '%g' text."""
    t = col_of(c).cast("string")
    m = F.nullif(F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*(?:out of\s*)?5", 1), F.lit(""))
    v = F.coalesce(m, _first_number(t)).try_cast("double")
    return F.when(v.between(0, 5), format_g(v))


def rating_label(v) -> Column:
    """'4 star', '2.5 star', or the no-rating label."""
    v = col_of(v)
    return (F.when(v.isNull(), F.lit(NO_RATING_LABEL))
            .when(v == F.floor(v), F.concat(v.cast("bigint").cast("string"), F.lit(" star")))
            .otherwise(F.concat(format_g(v), F.lit(" star"))))


def safe_ratio(n, d) -> Column:
    """Ratio with a zero guard: 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(col_of(n).cast("double"), col_of(d).cast("double")), F.lit(0.0))


def round_share(c, digits: int = 6) -> Column:
    """F32: shares are reported rounded to 6 places."""
    return F.round(col_of(c), digits)


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(col_of(c), F.lit(lo)), F.lit(hi))
