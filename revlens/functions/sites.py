"""Site names: channel, site family, star filter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revlens.functions.text import col_of, py_strip

__all__ = ["channel", "site_family", "star_filter", "CHANNEL_PREFIXES", "CHANNEL_NAMES"]

# Site prefixes and exact site names per channel.
CHANNEL_PREFIXES = [
    ("AMZ", ["amazon_", "amz_"]),
    ("BBY", ["bby_", "bestbuy_"]),
    ("WMT", ["wmt_", "walmart_"]),
]
CHANNEL_NAMES = {
    "amazon": "AMZ", "amz": "AMZ", "bestbuy": "BBY", "bby": "BBY",
    "walmart": "WMT", "wmt": "WMT", "csc": "CSC",
}
# Star digit -> filter name.
STAR_NAMES = {"5": "five_star", "4": "four_star", "3": "three_star", "2": "two_star", "1": "one_star"}


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def channel(site="site") -> Column:
    """Channel of a site key (prefix, then exact name); unknown sites give the
    upper-cased raw site."""
    raw = col_of(site)
    s = py_strip(F.lower(raw))
    prefixes = {p: ch for ch, ps in CHANNEL_PREFIXES for p in ps}
    pattern = "^(" + "|".join(prefixes) + ")"
    by_prefix = F.try_element_at(_lit_map(prefixes), F.regexp_extract(s, pattern, 1))
    return F.coalesce(by_prefix, F.try_element_at(_lit_map(CHANNEL_NAMES), s), F.upper(raw))


def site_family(site="site") -> Column:
    """P6 helper: 'amazon' / 'bestbuy' / 'walmart' family of a site key, else the site itself."""
    s = F.lower(col_of(site))
    return (F.when(s.startswith("amazon") | s.startswith("amz_"), F.lit("amazon"))
            .when(s.startswith("bestbuy") | s.startswith("bby_"), F.lit("bestbuy"))
            .when(s.startswith("walmart") | s.startswith("wmt_"), F.lit("walmart"))
            .otherwise(s))


def star_filter(site="site") -> Column:
    """'amazon_5' -> 'five_star' ...; NULL when the site carries no star digit."""
    digit = F.regexp_extract(F.lower(col_of(site)), r"(?:amazon|amz)_(\d)(?:\D|$)", 1)
    m = F.create_map(*[x for k, v in STAR_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, digit)
