"""Text normalisation, excerpts and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = [
    "WS", "col_of", "collapse_ws", "py_strip", "norm_key", "norm_match_text",
    "meaningful_tokens", "excerpt", "issue_summary", "text_hash", "review_key",
    "clean_text", "safe_name", "unescape_json_text", "strip_code_fence",
    "json_array_slice", "STOPWORDS", "NO_BODY_TEXT",
]

# The characters Python's str.isspace() treats as white space.
# Java's and RE2's \s cover only the ASCII ones, so we spell the class out;
# the same pattern text works in Spark (Java regex) and DuckDB (RE2).
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The same class without the blank, single Latin-1 characters one by one (Java tests these with
# one table look-up).
_NOT_BLANK = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Runs of white space other than one blank.  The look-ahead rejects visible ASCII, which is most
# of a text, before the class is tested.
_TO_COLLAPSE = rf"(?![!-~])(?:[{_NOT_BLANK}][{_NOT_BLANK} ]*+| [{_NOT_BLANK} ]++)"

# Stop words ignored when a phrase is split into tokens.
STOPWORDS = [
    "a", "an", "and", "are", "as", "be", "but", "by", "can", "could", "for",
    "from", "has", "have", "in", "is", "it", "no", "not", "of", "on", "or",
    "other", "please", "some", "the", "this", "to", "tv", "with",
]

# Fixed value: summary text used when a review has neither body nor title.
NO_BODY_TEXT = "原始评论无正文"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(col_of(c), _TO_COLLAPSE, " ")


def py_strip(c) -> Column:
    """Strip leading and trailing white space (Unicode-aware, like str.strip)."""
    return F.regexp_replace(col_of(c), "^" + WS + "+|" + WS + "+$", "")


def norm_key(c) -> Column:
    """NULL -> '', collapse white space, strip, lower case."""
    return F.lower(F.trim(collapse_ws(F.coalesce(col_of(c).cast("string"), F.lit("")))))


def norm_match_text(c) -> Column:
    """lower case, 'wi-fi' -> 'wifi', anything but [a-z0-9] -> blank, collapsed."""
    t = F.replace(F.lower(F.coalesce(col_of(c), F.lit(""))), F.lit("wi-fi"), F.lit("wifi"))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def meaningful_tokens(c) -> Column:
    """tokens of a normalised text with at least 3 letters that are not stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(col_of(c), " "),
                    lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def excerpt(c, n: int) -> Column:
    """collapsed text, cut to n-1 characters plus an ellipsis when longer than n."""
    t = F.trim(collapse_ws(F.coalesce(col_of(c).cast("string"), F.lit(""))))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def issue_summary(body="review_text", title="title", n: int = 220) -> Column:
    """body excerpt, else the title unless it is only 'x out of 5 stars', else a fixed text."""
    b = excerpt(body, n)
    t = excerpt(title, n)
    star_only = t.rlike(r"(?i)^\d+(?:\.\d+)?\s+out of 5 stars$")
    return (F.when(b != "", b)
            .when((t != "") & ~star_only, t)
            .otherwise(F.lit(NO_BODY_TEXT)))


def text_hash(c) -> Column:
    """SHA-256 hex of the collapsed, stripped text (equals hashlib on UTF-8)."""
    return F.sha2(F.trim(collapse_ws(F.coalesce(col_of(c), F.lit("")))), 256)


def review_key(model_id="model_id", site="site", url="source_url", rating="rating",
               date="review_date", author="author", title="title", body="review_text") -> Column:
    """SHA-256 of the stable review id: raw fields and collapsed title/body joined by '|'."""
    raw = [F.coalesce(col_of(x).cast("string"), F.lit("")) for x in (model_id, site, url, rating, date, author)]
    txt = [F.trim(collapse_ws(F.coalesce(col_of(x), F.lit("")))) for x in (title, body)]
    return F.sha2(F.concat_ws("|", *raw, *txt), 256)


def clean_text(c) -> Column:
    """collapse, strip, empty -> NULL."""
    return F.nullif(F.trim(collapse_ws(col_of(c))), F.lit(""))


def safe_name(c, max_len: int = 31) -> Column:
    """export-safe name: []:*?/\\ -> '_', stripped, blank -> 'sheet', at most 31 chars."""
    t = py_strip(F.translate(col_of(c).cast("string"), "[]:*?/\\", "_______"))
    return F.substring(F.when(t == "", F.lit("sheet")).otherwise(t), 1, max_len)


def unescape_json_text(c) -> Column:
    """escaped quote -> quote, escaped newline/return/tab -> blank, stripped."""
    t = col_of(c)
    t = F.replace(t, F.lit('\\"'), F.lit('"'))
    for esc in ("\\n", "\\r", "\\t"):
        t = F.replace(t, F.lit(esc), F.lit(" "))
    return py_strip(t)


def strip_code_fence(c) -> Column:
    """F16 part 1: drop a surrounding ``` / ```json fence."""
    t = py_strip(col_of(c))
    fenced = py_strip(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?" + WS + "*", ""),
                                       WS + "*```$", ""))
    return F.when(t.startswith("```"), fenced).otherwise(t)


def json_array_slice(c) -> Column:
    """F16 part 2: remove <think> blocks, then the text from the first '[' to the last ']'.

    NULL when there is no such bracket pair (the caller reports that as a status)."""
    t = py_strip(F.regexp_replace(strip_code_fence(c), r"(?is)<think>.*?</think>", ""))
    start = F.instr(t, "[")
    # position of the last ']' = length - position of ']' in the reversed text + 1
    end = F.when(F.instr(F.reverse(t), "]") > 0, F.length(t) - F.instr(F.reverse(t), "]") + 1).otherwise(F.lit(0))
    return F.when((start > 0) & (end > start), F.substring(t, start, end - start + 1))
