"""The main scalar functions as SQL functions (survey §2.12).

Every function is SQL text, built from the same fixed values as the Column forms (patterns, formats,
sizes) and parsed by Spark itself, so ``spark.sql("SELECT norm_key(title) ...")``, views
and join conditions run built-in expressions only.  A value that is used more than once is
bound as the parameter of a lambda.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from revlens.functions.dates import DATE_FORMATS, SHAPES
from revlens.functions.ratings import NUMBER
from revlens.functions.size import PREFIX_PATTERN, SITE_PATTERN, SIZE_SUFFIX, TEXT_PATTERN, UNKNOWN_SIZE
from revlens.functions.text import WS


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {text(f'^{WS}+|{WS}+$')}, '')"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def norm_key(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), {text(WS + '+')}, ' ')))"


def norm_match_text(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'wi-fi', 'wifi'), '[^a-z0-9]+', ' '))"


def parse_rating(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {text(NUMBER)}, 0), '') AS DOUBLE)"


def parse_date_text(x: str) -> str:
    zone, timed = text(r"\s*(?:[Zz]|[+-]\d\d:?\d\d)$"), text(r"^\d+-\d+-\d+[T ]\d+:\d+")
    clock = bound(f"regexp_replace(t, {zone}, '')", "p",
                  f"CASE WHEN p RLIKE {text(r'[T ]\d+:\d+:\d+$')} THEN p WHEN p RLIKE {text(r'[T ]\d+:\d+$')} THEN concat(p, ':00') "
                  f"ELSE regexp_replace(concat(p, '000000'), {text(r'(\.\d{6})\d*$')}, '$1') END")
    tries = ", ".join(f"CASE WHEN u RLIKE {text(SHAPES[f])} THEN try_to_timestamp(u, {text(f)}) END" if f in SHAPES
                      else f"try_to_timestamp(u, {text(f)})" for f in DATE_FORMATS)
    return bound(bound(x, "t", f"CASE WHEN t RLIKE {timed} THEN {clock} ELSE t END"), "u", f"coalesce({tries})")


def parse_review_date(x: str) -> str:
    plain = strip(f"replace({x}, '\u00a0', ' ')")
    after = bound(f"regexp_extract(s, {text('(?i)on' + WS + '+(.+)$')}, 1)", "a", f"CASE WHEN a <> '' THEN {strip('a')} ELSE s END")
    return parse_date_text(bound(plain, "s", after))


def iso_week_label(d: str) -> str:
    thursday = f"date_add({d}, 4 - ((dayofweek({d}) + 5) % 7 + 1))"
    return f"coalesce(concat(year({thursday}), '-W', lpad(weekofyear({d}), 2, '0')), '')"


def extract_size(size: str, site: str, model_id: str, model_name: str, *texts: str) -> str:
    grab = lambda x, pattern: f"nullif(regexp_extract(coalesce({x}, ''), {text(pattern)}, 1), '')"
    found = [grab(site, SITE_PATTERN), grab(model_id, PREFIX_PATTERN), grab(model_name, PREFIX_PATTERN), *(grab(t, TEXT_PATTERN) for t in texts)]
    given = "nullif(" + strip("coalesce(" + size + ", '')") + ", '')"
    return f"coalesce({given}, concat(coalesce({', '.join(found)}), {text(SIZE_SUFFIX)}), {text(UNKNOWN_SIZE)})"


# name -> (parameters, result type, SQL text over the parameters)
FUNCTIONS = {
    "norm_key": (["s STRING"], "STRING", norm_key("s")),
    "norm_match_text": (["s STRING"], "STRING", norm_match_text("s")),
    "parse_rating": (["s STRING"], "DOUBLE", parse_rating("s")),
    "parse_review_date": (["s STRING"], "TIMESTAMP", parse_review_date("parse_review_date.s")),
    "iso_week_label": (["d DATE"], "STRING", iso_week_label("d")),
    "extract_size": (["size STRING", "site STRING", "model_id STRING", "model_name STRING", "title STRING", "review_text STRING"], "STRING",
                     extract_size("size", "site", "model_id", "model_name", "title", "review_text")),
}


def register_sql_functions(spark: SparkSession, names=None) -> list:
    chosen = [n for n in FUNCTIONS if not names or n in names]
    for name in chosen:
        parameters, result, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {result} RETURN {body}")
    return chosen
