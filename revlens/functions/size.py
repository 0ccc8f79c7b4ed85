"""Screen size extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlens.functions.text import WS, col_of, py_strip

__all__ = ["SIZES", "UNKNOWN_SIZE", "ALL_SIZES", "extract_size", "extract_size_text", "size_label"]

# Allowed sizes in inches, the unit suffix and the two labels.
SIZES = "32|40|43|50|55|58|65|70|75|85|98|100"
SIZE_SUFFIX = "寸"
UNKNOWN_SIZE = "未知"
ALL_SIZES = "全部"

# Where a size stands in a site key, before a model name, and in a text.
SITE_PATTERN = f"(?:^|_)({SIZES})(?:$|_)"
PREFIX_PATTERN = f"(?i)^({SIZES})(?=[A-Z])"
TEXT_PATTERN = f"(?i)(?<![0-9])({SIZES}){WS}*(?:[\"”]|inch|inches|class|吋|寸)"


def size_label(n) -> Column:
    return F.concat(col_of(n), F.lit(SIZE_SUFFIX))


def _grab(c, pattern) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col_of(c).cast("string"), F.lit("")), pattern, 1), F.lit(""))


def extract_size(size="size", site="site", model_id="model_id", model_name="model_name",
                 texts=("title", "review_text", "issue_summary")) -> Column:
    """given size, else NN from site, model id/name prefix, then texts; 'NN寸' or unknown.

    ``texts`` lists the free-text columns to search (missing ones are skipped by the caller)."""
    given = F.nullif(py_strip(F.coalesce(col_of(size).cast("string"), F.lit(""))), F.lit(""))
    found = [_grab(site, SITE_PATTERN), _grab(model_id, PREFIX_PATTERN), _grab(model_name, PREFIX_PATTERN)]
    found += [_grab(t, TEXT_PATTERN) for t in texts]
    return F.coalesce(given, size_label(F.coalesce(*found)), F.lit(UNKNOWN_SIZE))


def extract_size_text(c) -> Column:
    """'Size: NN', 'NN inch'/'NN"', 'NN 寸' tried in this order on the cleaned text; NULL if none."""
    t = F.trim(F.regexp_replace(F.replace(col_of(c), F.lit("\u00a0"), F.lit(" ")), WS + "+", " "))
    # a size follows the word Size and a colon, or stands before a unit; Latin units end at a
    # word edge (so a quote sign needs a word right behind it), the Chinese ones at no letter
    latin, chinese = r"\s*(?:[- ]?(?:inch|inches|in\.|class)|[\"”])\b", r"\s*(?:吋|寸)(?![\p{L}\p{N}_])"
    size = rf"\b({SIZES})"
    pats = ["(?i)" + p for p in (r"\bSize\s*:\s*" + f"({SIZES})", size + latin, size + chinese)]
    return size_label(F.coalesce(*[_grab(t, p) for p in pats]))
