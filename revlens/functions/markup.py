"""Markup helpers (F15, F25, F26, O4, P10) as built-in expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

from revlens.functions.text import col_of

__all__ = ["unescape_entities", "unescape_markup", "strip_tags", "drop_scripts",
           "natural_key", "url_host", "url_param", "product_id"]

def _named_entities() -> dict:
    """Names with a closing semicolon, from the standard library's table."""
    return {name: char for name, char in html.entities.html5.items() if name.endswith(";")}


def unescape_entities(c) -> Column:
    """All named entities and decimal or hexadecimal references, each decoded once (so
    '&amp;lt;' gives '&lt;'); unknown ones stay.  Texts without '&' are not touched."""
    t = col_of(c)
    pattern = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    names = F.from_json(F.lit(json.dumps(_named_entities())), "map<string,string>")

    def one(ref):
        name = F.substring(ref, 2, F.length(ref))
        number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX](.*);", 1), 16, 10)).when(ref.startswith("&#"), F.regexp_extract(ref, "^&#(.*);", 1))
        code = number.try_cast("int")
        plane = F.when(code < 128, F.lpad(F.hex(code), 2, "0"))
        two = F.concat(F.hex(F.shiftright(code, 6) + 0xC0), F.hex(code.bitwiseAND(63) + 0x80))
        three = F.concat(F.hex(F.shiftright(code, 12) + 0xE0), F.hex(F.shiftright(code, 6).bitwiseAND(63) + 0x80), F.hex(code.bitwiseAND(63) + 0x80))
        four = F.concat(F.hex(F.shiftright(code, 18) + 0xF0), F.hex(F.shiftright(code, 12).bitwiseAND(63) + 0x80),
                        F.hex(F.shiftright(code, 6).bitwiseAND(63) + 0x80), F.hex(code.bitwiseAND(63) + 0x80))
        utf8 = plane.when(code < 0x800, two).when((code < 0x10000) & ~code.between(0xD800, 0xDFFF), three).when(code.between(0x10000, 0x10FFFF), four)
        char = F.decode(F.unhex(F.when(code > 0, utf8)), "UTF-8")
        return F.coalesce(F.when(number.isNotNull(), char).otherwise(F.try_element_at(names, name)), ref)
    refs, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("b"), refs.alias("r")),
                                      lambda x: F.concat(x["b"], F.when(x["r"].isNull(), F.lit("")).otherwise(one(x["r"])))), "")
    return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)


def unescape_markup(c) -> Column:
    """JS escapes (\\/ \\" \\n \\t) then entities."""
    t = col_of(c)
    for esc, ch in (("\\/", "/"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t")):
        t = F.replace(t, F.lit(esc), F.lit(ch))
    return unescape_entities(t)


def drop_scripts(c) -> Column:
    """Remove <script>, <style> and comments (their text is not page content)."""
    t = F.regexp_replace(col_of(c), r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", " ")
    return F.regexp_replace(t, r"(?s)<!--.*?-->", " ")


def strip_tags(c) -> Column:
    return F.regexp_replace(col_of(c), r"<[^>]*>", " ")


def natural_key(c) -> Column:
    """Digit runs compared as numbers of any length, text case-insensitive.

    A run is written as its length without leading zeros (ten digits) and these digits, so
    comparing the texts compares the numbers."""
    parts = F.regexp_extract_all(col_of(c), F.lit(r"(\d+|\D+)"), 1)

    def one(x):
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(x))
    return F.array_join(F.transform(parts, one), "")


def url_host(c) -> Column:
    return F.try_parse_url(col_of(c), F.lit("HOST"))


def url_param(c, key: str) -> Column:
    """one query parameter (NULL when absent or the URL does not parse)."""
    return F.try_parse_url(col_of(c), F.lit("QUERY"), F.lit(key))


# Where a shop's page path holds the product id, tried in order.
PRODUCT_ID = {
    "amazon": [r"(?i)/(?:product-reviews|dp)/([A-Z0-9]{10})"],
    "bestbuy": [r"/sku/(\d+)/reviews", r"/site/reviews/[^/]+/(\d+)"],
    "walmart": [r"/reviews/product/(\d+)", r"/ip/(?:[^/]+/)?(\d+)"],
}


def product_id(c, kind) -> Column:
    """F25 by shop kind: Amazon's ASIN (any case, upper-cased), Best Buy's SKU, Walmart's item
    id, each from the URL's path; NULL for other shops and other paths."""
    path, k = F.regexp_extract(col_of(c), r"^[^?#]*", 0), col_of(kind)
    first = lambda shop: F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in PRODUCT_ID[shop]])
    return (F.when(k == "amazon", F.upper(first("amazon"))).when(k == "bestbuy", first("bestbuy")).when(k == "walmart", first("walmart")))
