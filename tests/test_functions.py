"""Golden rows for the scalar functions (FIXTURES.md §5 and the edge cases of SURVEY §4.4)."""

import datetime as dt

from pyspark.sql import functions as F

from revlens.functions import dates as D
from revlens.functions import ratings as R
from revlens.functions import sites as S
from revlens.functions import size as Z
from revlens.functions import text as T


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_review_date_leftmost_and_last_on(spark):
    v = "Reviewed in Oregon on May 5, 2026"
    assert one(spark, D.parse_review_date, v) is None          # F20: leftmost 'on' (in 'Oregon')
    assert one(spark, D.dashboard_date, v) == dt.date(2026, 5, 5)  # last 'on '
    assert one(spark, D.format_review_date, "Reviewed in the United States on March 3, 2025") == "2025-03-03"
    assert one(spark, D.format_review_date, "yesterday") == ""
    assert one(spark, D.format_date_or_raw, "yesterday") == "yesterday"
    assert one(spark, D.format_date_or_raw, "3/4/2025") == "2025-03-04"


def test_iso_week(spark):
    assert one(spark, D.iso_week_label, dt.date(2025, 1, 1), "date") == "2025-W01"
    assert one(spark, D.iso_week_label, dt.date(2027, 1, 1), "date") == "2026-W53"
    assert one(spark, D.iso_week_label, None, "date") == ""


def test_overall_rating_text(spark):
    cases = {"15 reviews, 4.2 out of 5": "1", "4.55": "4.5", "4.3 out of 5": "4.3", "45": "4", "5": "5",
             "9 points": None}
    for raw, want in cases.items():
        assert one(spark, R.overall_rating_text, raw) == want, raw


def test_parse_rating(spark):
    assert one(spark, R.parse_rating, "4.0 out of 5 stars") == 4.0
    assert one(spark, R.parse_rating, "10 points") == 10.0
    assert one(spark, R.parse_rating_0_5, "10 points") is None
    assert one(spark, R.parse_rating, "no rating") is None
    assert one(spark, R.rating_label, 4.0, "double") == "4 star"
    assert one(spark, R.rating_label, 2.5, "double") == "2.5 star"


def test_sizes(spark):
    df = spark.createDataFrame(
        [("the 155\" tv", "x", "A1", "A1"), ("", "bby_55", "A1", "A1"), ("", "s", "32H1", "32H1"),
         ("a 55 Inch tv", "s", "Z", "Z")],
        "title string, site string, model_id string, model_name string")
    got = [r[0] for r in df.select(Z.extract_size(F.lit(None), texts=["title"])).collect()]
    assert got == ["未知", "55寸", "32寸", "55寸"]
    assert one(spark, Z.extract_size_text, "Size: 65 inches") == "65寸"


def test_channel(spark):
    cases = {"amazon_5": "AMZ", "AMZ_3": "AMZ", " wmt ": "WMT", "bestbuy": "BBY", "csc": "CSC", "target": "TARGET",
             "walmart_x": "WMT", "Other Site ": "OTHER SITE "}
    for raw, want in cases.items():
        assert one(spark, S.channel, raw) == want, raw
    assert one(spark, S.star_filter, "amazon_5") == "five_star"
    assert one(spark, S.star_filter, "bby_55") is None


def test_text_helpers(spark):
    assert one(spark, T.norm_key, "  Hello 　World\n") == "hello world"
    assert one(spark, T.norm_key, None) == ""
    assert one(spark, T.norm_match_text, "Wi-Fi   keeps-dropping!") == "wifi keeps dropping"
    assert one(spark, lambda c: T.excerpt(c, 5), "abcdefgh") == "abcd…"
    assert one(spark, lambda c: T.issue_summary(c, c), None) == T.NO_BODY_TEXT
    assert one(spark, T.safe_name, "a/b:c") == "a_b_c"
    assert one(spark, T.json_array_slice, "```json\n<think>x</think>[1, 2]\n```") == "[1, 2]"
    assert one(spark, T.json_array_slice, "no array") is None
    import hashlib
    assert one(spark, T.text_hash, " a  b ") == hashlib.sha256(b"a b").hexdigest()


def test_message_text(spark):
    from revlens.operators.labels import message_text
    rows = ['{"choices": [{"message": {"content": "  [1]  "}}]}',
            '{"choices": [{"message": {"content": [{"type": "reasoning", "text": "x"}, {"type": "text", "text": "a"},'
            ' {"type": "output_text", "text": "b"}]}}]}',
            '{"choices": []}', '{"choices": [{"message": {"content": ""}}]}', "not json"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [x[0] for x in df.select(message_text(F.col("r"))).collect()] == ["[1]", "a\nb", None, None, None]


def test_natural_key_of_long_numbers(spark):
    from revlens.functions.markup import natural_key
    names = ["p" + "9" * 25, "p1" + "0" * 25, "p0002", "p10", "P2a", "p" + "9" * 24]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(natural_key("n"), "n").collect()]
    assert got == ["p0002", "P2a", "p10", "p" + "9" * 24, "p" + "9" * 25, "p1" + "0" * 25]


def test_entities_decode_once(spark):
    import html
    from revlens.functions.markup import unescape_entities
    texts = ["&amp;lt; &lt;b&gt;", "&eacute;&#233;&#xE9;&#x1F600;", "&unknown; & &amp", "no", "&NotEqualTilde;&nbsp;&euro;", None, "a&#38;#38;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(unescape_entities("t")).collect()]
    assert got[:2] == [html.unescape(t) for t in texts[:2]] and got[2] == texts[2] and got[3] == "no" and got[4] == html.unescape(texts[4]) and got[5] is None and got[6] == "a&#38;"


def test_lenient_dates(spark):
    from revlens.functions.dates import parse_review_date
    texts = ["2025-02-01T10:11:12Z", "2025-02-01T10:11:12.5+02:00", "2025-02-01T10:11:12.123456789", "2025-02-01 10:11", "May 5 2026", "5 May 2026", "on 2025-02-01", "bad"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [str(r[0]) for r in df.select(parse_review_date("d")).collect()]
    assert got == ["2025-02-01 10:11:12", "2025-02-01 10:11:12.500000", "2025-02-01 10:11:12.123456", "2025-02-01 10:11:00", "2026-05-05 00:00:00", "2026-05-05 00:00:00", "2025-02-01 00:00:00", "None"]


def test_product_ids_by_shop(spark):
    from revlens.functions.markup import product_id
    rows = [("https://a/x/dp/b012345678?x=1", "amazon", "B012345678"), ("https://a/portal/customer-reviews/B012345678", "amazon", None),
            ("https://b/product/s/A/sku/6501/reviews?p", "bestbuy", "6501"), ("https://b/site/reviews/slug/6502", "bestbuy", "6502"), ("https://b/site/x/6503.p?skuId=1", "bestbuy", None),
            ("https://w/ip/name/77", "walmart", "77"), ("https://w/reviews/product/78", "walmart", "78"), ("https://w/ip/79", "walmart", "79"), ("https://w/ip/79", "generic:w", None)]
    df = spark.createDataFrame(rows, "u string, k string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", product_id("u", "k")).collect())
