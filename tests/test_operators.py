"""Operator invariants and hand-made edge rows."""

from pyspark.sql import functions as F

from revlens import fixtures
from revlens.operators import dedupe, merge, reports
from revlens.operators.classify import classify_keyword
from revlens.operators.sequence import sequence
from revlens.schema import REVIEW_COLUMNS
from tests.conftest import SMALL


def rows(spark, data):
    cols = ["review_ord"] + REVIEW_COLUMNS
    full = [tuple([i] + [d.get(c) for c in REVIEW_COLUMNS]) for i, d in enumerate(data)]
    return spark.createDataFrame(full, ", ".join(f"{c} {'long' if c == 'review_ord' else 'string'}" for c in cols))


def test_keep_first_edge_rows(spark):
    base = {"model_id": "A7", "channel": "AMZ", "site": "amazon_1", "title": "Bad", "review_text": "Broken  set"}
    data = [dict(base), dict(base, title="  bad "), dict(base, review_text="broken set", author=""),
            dict(base, site="amazon_2"), dict(base, author=None)]
    got = sorted(r.review_ord for r in dedupe.keep_first(rows(spark, data)).collect())
    assert got == [0, 3]  # case/blank variants and NULL vs '' collapse; another site is kept


def test_keep_first_independent_of_partitions(spark):
    raw = fixtures.reviews(spark, SMALL)
    a = sorted(r.review_ord for r in dedupe.keep_first(raw.repartition(1)).collect())
    b = sorted(r.review_ord for r in dedupe.keep_first(raw.repartition(7)).collect())
    again = sorted(r.review_ord for r in dedupe.keep_first(dedupe.keep_first(raw)).collect())
    assert a == b == again


def test_merge_replay_adds_nothing(spark):
    raw = fixtures.reviews(spark, SMALL)
    stored = dedupe.keep_first(raw)
    stats = merge.merge_stats(stored, raw).first()
    assert stats.added_count == 0 and stats.total_count == stats.existing_count


def test_merge_added_negative_when_stored_has_duplicates(spark):
    raw = fixtures.reviews(spark, SMALL)
    stats = merge.merge_stats(raw, raw.limit(0)).first()
    assert stats.added_count < 0


def test_classify_tie_orders(spark):
    tax = fixtures.taxonomy(spark, [("Zeta", ["box"]), ("Alpha", ["refund"]), ("Mid", ["os"])])
    df = spark.createDataFrame([(0, "x", "box and refund"), (1, "", "most things"), (2, None, "nothing")],
                               "review_ord long, title string, review_text string")
    got = {r.review_ord: (r.primary, r.secondary) for r in classify_keyword(df, tax).collect()}
    assert got[0] == ("Alpha", "refund")      # equal scores: category name decides
    assert got[1] == ("Mid", "os")            # substring, not word match
    assert got[2] == ("Other", "Other")


def test_token_arm(spark):
    tax = fixtures.taxonomy(spark, [("Net", ["wireless network drops"])])
    df = spark.createDataFrame([(0, "", "my network drops often"), (1, "", "network only")],
                               "review_ord long, title string, review_text string")
    got = {r.review_ord: (r.primary, r.score) for r in classify_keyword(df, tax).collect()}
    assert got[0] == ("Net", 2) and got[1] == ("Other", 0)


def test_shares_sum_to_one(spark):
    from revlens.plans.analysis import analysis, classified
    a = analysis(spark, SMALL)
    ic = reports.issue_counts(classified(a), a.taxonomy)
    for r in ic.groupBy("model_id").agg(F.sum("share").alias("s")).collect():
        assert abs(r.s - 1) < 1e-5


def test_sequence_is_dense_per_group(spark):
    df = spark.range(0, 500).withColumn("g", (F.col("id") % 3).cast("string")).withColumnRenamed("id", "review_ord")
    out = sequence(df.repartition(5), [F.col("review_ord").desc()], ["g"], "seq")
    for r in out.groupBy("g").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).collect():
        assert r.a == 1 and r.b == r.n
    top = out.filter("g = '0' and seq = 1").first()
    assert top.review_ord == 498


def many_phrases(spark, n=5000):
    rules = [(f"Cat{i % 40:02d}", [f"filler phrase number{i}x"]) for i in range(n - 2)] + [("Net", ["wireless network drops"]), ("Other", ["Please add comments"])]
    return fixtures.taxonomy(spark, rules)


def test_taxonomy_of_five_thousand_phrases(spark):
    from revlens.operators import labels as L
    from revlens.operators.classify import phrase_match, taxonomy_specs
    tax = many_phrases(spark)
    df = spark.createDataFrame([(0, "A7", "", "my wireless network drops"), (1, "A7", "", "filler phrase number17x here"), (2, "A7", None, "nothing")],
                               "review_ord long, model_id string, title string, review_text string")
    c = classify_keyword(df, tax)
    got = {r.review_ord: (r.primary, r.secondary, r.score) for r in c.collect()}
    assert got == {0: ("Net", "wireless network drops", 11), 1: ("Cat17", "filler phrase number17x", 11), 2: ("Other", "Other", 0)}
    assert phrase_match(df, tax).filter("review_ord = 0").select("phrase").distinct().count() == 1
    counts = {r.primary: r.keywords for r in reports.issue_counts(c, tax).collect()}
    assert counts["Net"] == "wireless network drops" and counts["Cat17"] == "filler phrase number17x"
    specs = taxonomy_specs(tax)
    labels = spark.createDataFrame([("Net", "wireless network drops", ""), ("Net", "filler phrase number17x", "")], "primary string, secondary string, reason string")
    assert [r.primary for r in L.validate_labels(labels, specs).collect()] == ["Net", "Other"]
    items = df.withColumn("item_id", F.col("review_ord")).withColumn("batch_id", F.lit(0).cast("long"))
    for name in ("cache_key", "model_name", "channel", "rating", "review_date", "issue_summary"):
        items = items.withColumn(name, F.lit(None).cast("string"))
    assert "filler phrase number4997x" in L.classify_requests(items, specs).first().payload


def test_changed_taxonomy_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([(0, "", "box")], "review_ord long, title string, review_text string")
    path, schema = str(tmp_path / "tax"), "category string, cat_ord int, phrase string, phrase_ord int"
    for category in ("First", "Second"):
        spark.createDataFrame([(category, 0, "box", 0)], schema).write.mode("overwrite").parquet(path)
        assert classify_keyword(df, spark.read.parquet(path)).first().primary == category


def plain_cutoff(pages, k):
    """Pages kept of each target, by a loop."""
    kept = set()
    for target in {t for t, _, _ in pages}:
        run = 0
        for _, page, new in sorted(p for p in pages if p[0] == target):
            kept.add((target, page))
            run = 0 if new else run + 1
            if run == k:
                break
    return kept


def test_crawl_cutoff_with_one_hot_target(spark):
    import random
    from revlens.operators.pages import crawl_cutoff
    r = random.Random(5)
    pages = [("hot", i, int(r.random() < 0.8)) for i in range(990)] + [(f"t{i % 5}", 2000 + i, int(r.random() < 0.5)) for i in range(60)] + [("empty", 5000 + i, 0) for i in range(4)]
    df = spark.createDataFrame(pages, "target string, page_id long, n_new long").repartition(6)
    for k in (1, 3, 5):
        out = crawl_cutoff(df, k).collect()
        assert len(out) == len(pages) and {(x.target, x.page_id) for x in out if x.kept} == plain_cutoff(pages, k)


def test_page_records_differ_beyond_any_prefix(spark):
    from revlens.operators.pages import new_records_per_page
    long = "same words " * 60
    df = spark.createDataFrame([(1, "http://h/1", f"<p>{long}one</p>"), (2, "http://h/2", f"<p>{long}two</p>"), (3, "http://h/3", f"<p>{long}ONE</p>"), (4, "http://h/4", "")],
                               "page_id long, url string, html string")
    assert {r.page_id: r.n_new for r in new_records_per_page(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_pivot_has_every_channel(spark):
    from revlens.operators.facets import model_channel_pivot
    df = spark.createDataFrame([("A", "AMZ"), ("A", "NEW SHOP"), ("B", "AMZ"), ("A", "AMZ")], "model_id string, channel string")
    got = {r.model_id: r.asDict() for r in model_channel_pivot(df).collect()}
    assert got["A"] == {"model_id": "A", "AMZ": 2, "NEW SHOP": 1, "total": 3} and got["B"]["NEW SHOP"] == 0


def test_grid_with_repeated_headings(spark):
    from revlens.operators.grid import grid_tables
    df = spark.createDataFrame([("s", 1, ["k", "v", "v"]), ("s", 2, ["a", "1", "2"])], "sheet string, row_idx long, cells array<string>")
    assert [tuple(r) for r in grid_tables(df, ["k", "v"], ["k", "v"]).collect()] == [("s", 2, "a", "2")]
