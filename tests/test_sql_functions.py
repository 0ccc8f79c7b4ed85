"""The SQL functions agree with the Column forms and work wherever SQL takes an expression."""

from pyspark.sql import functions as F

from revlens.functions import dates as D
from revlens.functions import ratings as R
from revlens.functions import text as T
from revlens.functions.size import extract_size
from revlens.functions.sql import register_sql_functions

TEXTS = ["  A  B\n　c ", "Wi-Fi 6E!", "4.5 out of 5", "Reviewed on 2025-03-04T05:06:07.89+01:00", "on May 5, 2025", "3/4/2025", "5 June 2024", "2025-1-2 03:04",
         "it's a \\ 55\" class 'x'", "", " ", None, "\x1c65 inch", "Reviewed in Oregon on May 5, 2025", "yesterday", " ", "x\x85y", "a   b\t\tc"]


def test_functions_equal_the_columns(spark):
    register_sql_functions(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, s string")
    rows.createOrReplaceTempView("texts_in")
    got = spark.sql("select n, norm_key(s) a, norm_match_text(s) b, parse_rating(s) c, parse_review_date(s) d, iso_week_label(cast(parse_review_date(s) as date)) e, "
                    "extract_size(null, s, s, null, s, s) f from texts_in order by n").collect()
    want = rows.select("n", T.norm_key("s").alias("a"), T.norm_match_text("s").alias("b"), R.parse_rating("s").alias("c"), D.parse_review_date("s").alias("d"),
                       D.iso_week_label(D.parse_review_date("s").cast("date")).alias("e"),
                       extract_size(F.lit(None), "s", "s", F.lit(None), ["s", "s"]).alias("f")).orderBy("n").collect()
    assert list(map(tuple, got)) == list(map(tuple, want))


def test_functions_in_a_view_and_in_a_join_condition(spark):
    register_sql_functions(spark)
    spark.createDataFrame([(1, "A  b"), (2, "c")], "n int, s string").createOrReplaceTempView("left_in")
    spark.createDataFrame([(7, " a B "), (8, "d")], "m int, t string").createOrReplaceTempView("right_in")
    spark.sql("create or replace temporary view keyed as select n, norm_key(s) k from left_in where norm_key(s) <> ''")
    assert [tuple(r) for r in spark.sql("select n, m from keyed join right_in on k = norm_key(t)").collect()] == [(1, 7)]
    assert [r.n for r in spark.sql("select n from left_in l where exists (select 1 from right_in r where norm_key(r.t) = norm_key(l.s))").collect()] == [1]


def test_blank_collapsing_equals_the_plain_class(spark):
    import random
    r = random.Random(4)
    parts = [" ", "  ", "\t", "\n", "\x1c", "\x85", " ", " ", " ", "​", "　", "a", "é", "!", "~", "¡", "中", "\U0001f600", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert df.where(~T.collapse_ws("s").eqNullSafe(F.regexp_replace("s", T.WS + "+", " "))).count() == 0
