"""The substring index gives what scanning every text for every phrase gives."""

import random

import pytest
from pyspark.sql import functions as F

from revlens import fixtures
from revlens.operators import classify
from revlens.operators.phrase_index import pattern_count

LETTERS = ["ab", "abc", "bca", "cab", "ba", "aab", "wifi", "no", "the"]


def rules(seed, n):
    r = random.Random(seed)
    return [(f"C{i % 7}", [" ".join(r.choice(LETTERS) for _ in range(r.randrange(1, 5)))]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_scan(spark, monkeypatch, seed):
    tax = fixtures.taxonomy(spark, rules(seed, 120) + [("Rep", ["abc abc xyz", "abc"]), ("Cut", ["bc ca"]), ("Blank", [" !! "])])
    r = random.Random(seed + 10)
    texts = ["".join(r.choice("abc  wifnothe") for _ in range(r.randrange(0, 40))) for _ in range(200)] + [None, "", "abcab cab", "ABC-ABC"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "review_ord long, title string, review_text string")
    assert pattern_count(classify.taxonomy_specs(tax)) > 9
    out = {}
    for limit in (0, 10 ** 6):
        monkeypatch.setattr(classify, "DIRECT_PATTERNS", limit)
        pairs = sorted(map(tuple, classify.phrase_match(df, tax).collect()))
        best = sorted(map(tuple, classify.classify_keyword(df, tax).select("review_ord", "primary", "secondary", "score").collect()))
        out[limit] = pairs, best
    assert out[0] == out[10 ** 6] and out[0][0]


def test_many_phrases_are_no_scans_and_no_joins(spark):
    tax = fixtures.taxonomy(spark, [(f"Cat{i % 40:02d}", [f"filler phrase number{i}x"]) for i in range(5000)])
    df = spark.range(3000).select(F.col("id").alias("review_ord"), F.lit("").alias("title"), F.format_string("a filler phrase number%dx", F.col("id")).alias("review_text"))
    out = classify.classify_keyword(df, tax).select("review_ord", "primary", "secondary", "score")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan and "Exchange" not in plan
    assert out.where(F.col("secondary") == F.format_string("filler phrase number%dx", F.col("review_ord"))).count() == 3000
