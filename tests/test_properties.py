"""Scalar functions against plain Python statements of the rules on random strings."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.functions import ratings as R
from revlens.functions import sites as S
from revlens.functions import text as T

PIECES = st.sampled_from(list("aAbZé ß\t\n\u00a0\u3000-_.,:0123456789") + ["Wi-Fi", "The", "amazon_", "bby_", "4.5"])
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=40)


def py_norm_key(v):
    return "" if v is None else re.sub(r"\s+", " ", v).strip().lower()


def py_match(v):
    t = v.lower().replace("wi-fi", "wifi")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]+", " ", t)).strip()


def py_excerpt(v, n):
    t = re.sub(r"\s+", " ", v or "").strip()
    return t if len(t) <= n else t[: n - 1] + "…"


def py_rating(v):
    m = re.search(r"[0-9]+(?:\.[0-9]+)?", v) if v is not None else None
    return float(m.group(0)) if m else None


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@settings(max_examples=15, deadline=None)
@given(values=TEXTS)
def test_text_rules(spark, values):
    values = values + [None]
    assert run(spark, values, T.norm_key) == [py_norm_key(v) for v in values]
    assert run(spark, values, lambda c: T.excerpt(c, 7)) == [py_excerpt(v, 7) for v in values]
    ascii_values = [v for v in values if v is None or v.isascii()]  # lower() differs only outside ASCII rules
    assert run(spark, ascii_values, T.norm_match_text) == [py_match(v or "") for v in ascii_values]


@settings(max_examples=15, deadline=None)
@given(values=TEXTS)
def test_rating_rule(spark, values):
    assert run(spark, values, R.parse_rating) == [py_rating(v) for v in values]


@settings(max_examples=10, deadline=None)
@given(values=st.lists(st.sampled_from(["amazon_5", " AMZ_3 ", "bby_55", "bestbuy", " wmt ", "walmart_x", "csc",
                                         "target", "Other Site", "amz", "BBY"]), min_size=1, max_size=10))
def test_channel_rule(spark, values):
    def py_channel(site):
        s = site.lower().strip()
        for ch, ps in S.CHANNEL_PREFIXES:
            if s.startswith(tuple(ps)):
                return ch
        return S.CHANNEL_NAMES.get(s, site.upper())
    assert run(spark, values, S.channel) == [py_channel(v) for v in values]
