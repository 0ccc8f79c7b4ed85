"""Free-text review dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlens.functions.text import WS, col_of, py_strip

__all__ = [
    "DATE_FORMATS", "parse_date_text", "parse_review_date", "format_review_date",
    "clean_review_date", "dashboard_time", "dashboard_date", "iso_week_label", "format_date_or_raw",
]

# Parameter: formats tried in order by the lenient parser.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "M/d/yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/M/d",
    "MMMM d yyyy",
    "MMM d yyyy",
    "d MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
]


def _nbsp_stripped(c) -> Column:
    return py_strip(F.replace(col_of(c).cast("string"), F.lit("\u00a0"), F.lit(" ")))


# Shape of the texts each format can parse (a necessary condition).  A format is
# tried only on texts of its shape: a failed parse is costly (it is signalled by an
# exception inside the parser), a regular-expression test is not.
SHAPES = {
    "yyyy-MM-dd": r"^\d+-\d+-\d+$",
    "M/d/yyyy": r"^\d+/\d+/\d+$",
    "MMMM d, yyyy": r"^\p{L}+ \d+, \d+$",
    "MMM d, yyyy": r"^\p{L}+ \d+, \d+$",
    "d MMMM yyyy": r"^\d+ \p{L}+ \d+$",
    "yyyy-MM-dd HH:mm:ss": r"^\d+-\d+-\d+ \d+:\d+:\d+$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d+-\d+-\d+T\d+:\d+:\d+$",
    "yyyy/M/d": r"^\d+/\d+/\d+$",
    "MMMM d yyyy": r"^\p{L}+ \d+ \d+$",
    "MMM d yyyy": r"^\p{L}+ \d+ \d+$",
    "d MMM yyyy": r"^\d+ \p{L}+ \d+$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": r"^\d+-\d+-\d+T\d+:\d+:\d+\.\d{6}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d+-\d+-\d+ \d+:\d+:\d+\.\d{6}$",
}


def parse_date_text(c, formats=DATE_FORMATS) -> Column:
    """Lenient parse: the first format that matches the whole text; NULL otherwise.  An ISO
    time may carry a zone (its clock time counts) and any number of fraction digits.

    The text is bound once, as the element of an array, so the many formats do not repeat the
    expression that makes it."""
    def iso(t):
        plain = F.regexp_replace(t, r"\s*(?:[Zz]|[+-]\d\d:?\d\d)$", "")
        timed = (F.when(plain.rlike(r"[T ]\d+:\d+:\d+$"), plain).when(plain.rlike(r"[T ]\d+:\d+$"), F.concat(plain, F.lit(":00")))
                 .otherwise(F.regexp_replace(F.concat(plain, F.lit("000000")), r"(\.\d{6})\d*$", "$1")))
        return F.when(t.rlike(r"^\d+-\d+-\d+[T ]\d+:\d+"), timed).otherwise(t)

    def parsed(t):
        return F.coalesce(*[F.when(t.rlike(SHAPES[f]), F.try_to_timestamp(t, F.lit(f))) if f in SHAPES else F.try_to_timestamp(t, F.lit(f)) for f in formats])
    return F.get(F.transform(F.transform(F.array(col_of(c)), iso), parsed), 0)


def parse_review_date(c, formats=DATE_FORMATS) -> Column:
    """text after the leftmost 'on' + white space (if any), parsed leniently."""
    t = _nbsp_stripped(c)
    after = F.regexp_extract(t, "(?i)on" + WS + "+(.+)$", 1)
    t = F.when(after != "", py_strip(after)).otherwise(t)
    return parse_date_text(t, formats)


def format_review_date(c, formats=DATE_FORMATS) -> Column:
    """yyyy-MM-dd of F20, or ''."""
    return F.coalesce(F.date_format(parse_review_date(c, formats), "yyyy-MM-dd"), F.lit(""))


def clean_review_date(c) -> Column:
    """text after the last 'on ' (any case), stripped; '' for NULL."""
    t = F.coalesce(_nbsp_stripped(c), F.lit(""))
    return F.when(t.rlike("(?i)on "), py_strip(F.regexp_extract(t, "(?is)^.*on (.*)$", 1))).otherwise(t)


def dashboard_time(c, formats=DATE_FORMATS) -> Column:
    """F22, then the lenient parse: the date and time that sorting goes by."""
    return parse_date_text(clean_review_date(c), formats)


def dashboard_date(c, formats=DATE_FORMATS) -> Column:
    """Date used by the dashboard facets: F22 then the lenient parse, as DATE."""
    return dashboard_time(c, formats).cast("date")


def iso_week_label(d) -> Column:
    """ISO week-year and week as 'YYYY-Wnn'; '' for NULL."""
    d = col_of(d)
    iso_weekday = (F.dayofweek(d) + 5) % 7 + 1          # Monday = 1 ... Sunday = 7
    week_year = F.year(F.date_add(d, (F.lit(4) - iso_weekday).cast("int")))  # year of that week's Thursday
    label = F.concat(week_year.cast("string"), F.lit("-W"),
                     F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return F.coalesce(label, F.lit(""))


def format_date_or_raw(c, formats=DATE_FORMATS) -> Column:
    """yyyy-MM-dd when the whole text parses, else the raw text ('' for NULL)."""
    raw = col_of(c).cast("string")
    return F.coalesce(F.date_format(parse_date_text(py_strip(raw), formats), "yyyy-MM-dd"), raw, F.lit(""))
