"""Captured pages and sources: profiles, size fall-back, capture status, carried ratings, cut-off lengths, files."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from revlens.functions import dom
from revlens.operators import extract as EX
from revlens.operators import pages as PG
from revlens.operators.targets import site_profile
from revlens.sources.reviews import read_captured_pages
from tests.conftest import ROOT, SMALL


def test_profiles_by_name_prefix_and_default(spark):
    sites = ["Amazon", " amazon_5 ", "amz_x_y", "bby", "bestbuy_55", "wmt_", "target", "amazonia", "amz", "shop", "", None, "_x"]
    got = [r.profile for r in EX.with_profile(spark.createDataFrame([(i, s) for i, s in enumerate(sites)], "n long, site string")).orderBy("n").collect()]
    assert got == ["amazon", "amazon", "amazon", "bestbuy", "bestbuy", "walmart", "target", "generic", "generic", "generic", "generic", "generic", "generic"]
    more = EX.profile_sites(spark).union(spark.createDataFrame([("shop", False, "target"), ("new_", True, "walmart"), ("new_", True, "walmart")], EX.profile_sites(spark).schema))
    out = EX.with_profile(spark.createDataFrame([("shop",), ("new_1",)], "site string"), sites=more).orderBy("site").collect()
    assert [r.profile for r in out] == ["walmart", "target"]


def test_pages_routed_by_site_profile_give_rows(spark):
    target = "<div data-test='review'><b data-test='rating'>4</b><div data-test='review-body'>fine</div></div>"
    other = "<div data-hook='review'><span class='review-title'>Good</span><div class='review-text-content'><span>works</span></div></div>"
    rows = spark.createDataFrame([(1, "target", target), (2, "shop", other), (3, "target", other)], "page_id long, site string, html string")
    got = {(r.page_id, r.title, r.review_text) for r in EX.extract_reviews(rows.withColumn("profile", site_profile("site"))).collect()}
    assert got == {(1, None, "fine"), (2, "Good", "works")}


def test_size_outside_the_format_strip(spark):
    block = "<div data-hook='review'><span data-hook='review-body'><span>nice</span></span>{}</div>"
    cases = {1: "<div class='a-row a-spacing-none'>Color: red</div><div class='a-row a-spacing-mini'>55 inch panel</div>",
             2: "<div class='a-row a-spacing-none'>Size: 65</div><div class='a-row a-spacing-mini'>55 inch panel</div>",
             3: "<div class='a-row'>55 inch panel</div>",
             4: "<div data-hook='format-strip'>Color: red</div><div class='a-row a-spacing-mini'>55 inch</div>",
             5: "<div class='a-row a-spacing-none'>fits 12 people</div>"}
    rows = spark.createDataFrame([(i, block.format(h), "amazon") for i, h in cases.items()], "page_id long, html string, profile string")
    assert {r.page_id: r.size for r in EX.extract_reviews(rows).collect()} == {1: "55寸", 2: "65寸", 3: None, 4: None, 5: None}


def test_nearest_holder_follows_the_order_of_selectors():
    page = dom.parse("<div class='review'><li id='customer_review-9'><div><p>x</p></div></li></div>")
    p = next(dom.select(page, "p"))
    holder = EX.PROFILES["amazon"]["holder"]
    assert dom.nearest(p, holder).attrs["id"] == "customer_review-9"
    assert dom.nearest(p, ["div.review", "li"]).attrs["class"] == "review" and dom.nearest(p, ["section"]) is None


RECORDS = "model_id string, site string, source_rank int, n int"


def test_a_source_that_answered_without_rows_wins(spark):
    rows = spark.createDataFrame([("A", "s", 2, 1), ("A", "s", 3, 2), ("B", "s", 2, 3), ("C", "s", 1, 4)], RECORDS)
    status = spark.createDataFrame([("A", "s", 1, True), ("B", "s", 1, False), ("C", "s", 1, True), ("C", "s", 1, True), ("D", "s", 1, True), ("E", "s", 1, False), ("B", "s", 0, None)],
                                   "model_id string, site string, source_rank int, answered boolean")
    used = {r.model_id: (r.source_rank, r.n_records) for r in EX.sources_used(rows, status).collect()}
    assert used == {"A": (1, 0), "B": (2, 1), "C": (1, 1), "D": (1, 0)}
    assert sorted(r.n for r in EX.source_precedence(rows, status=status).collect()) == [3, 4]
    assert sorted(r.n for r in EX.source_precedence(rows).collect()) == [1, 3, 4]


def test_carried_rating(spark):
    pages = spark.createDataFrame([("A", 1, None), ("A", 2, "4"), ("A", 3, "3"), ("A", 4, None), ("B", 1, "2"), ("C", 1, None)], "model_id string, page_id long, overall_rating string")
    product = spark.createDataFrame([("B", "4.5"), ("B", "4.7"), ("C", None)], "model_id string, overall_rating string")
    got = {(r.model_id, r.page_id): r.overall_rating for r in EX.carried_rating(pages, product).collect()}
    assert got == {("A", 1): None, ("A", 2): "4", ("A", 3): "4", ("A", 4): "4", ("B", 1): "4.5", ("C", 1): None}


def test_cut_off_lengths_by_source_in_one_run(spark):
    counts = {"five": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 9], "three": [0, 0, 1, 0, 0, 0, 9], "one": [1, 0, 9], "none": [1, 1], "short": [0]}
    rows = spark.createDataFrame([(t, i + 1, n) for t, ns in counts.items() for i, n in enumerate(ns)], "target string, page_id long, n_new long")
    sources = spark.createDataFrame([("five", "walmart"), ("three", "walmart_feed"), ("one", "amazon"), ("none", "bestbuy"), ("gone", "walmart")], "target string, source string")
    out = PG.crawl_cutoff(rows, PG.cutoff_lengths(sources)).collect()
    assert {r.target: r.stop_at for r in out} == {"five": 11, "three": 6, "one": 2, "none": None, "short": 1}
    assert sorted((r.target, r.page_id) for r in out if not r.kept) == [("five", 12), ("one", 3), ("three", 7)]


def test_captured_files_lose_bad_bytes_only(spark):
    folder = tempfile.mkdtemp()
    for name, data in (("A7/page10.html", b"caf\xc3\xa9 \xff\xfe ok"), ("A7/page2.htm", b"x"), ("A7/page3.htm", b""), ("B 7+1%/p.html", "né".encode("latin-1") + b"\xe9x"), ("B 7+1%/p.txt", b"no")):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    got = [(r.model_id, r.file_name, r.html) for r in read_captured_pages(spark, folder).orderBy("model_id", "file_key").collect()]
    assert got == [("A7", "page2.htm", "x"), ("A7", "page10.html", "café  ok"), ("B 7+1%", "p.html", "nx")]


def test_sorting_reads_the_date_after_the_last_on(spark):
    from revlens.operators import reports
    rows = spark.createDataFrame([(1, "Reviewed in Oregon on May 5, 2025"), (2, "2024-01-01"), (3, None)], "review_ord long, review_date string")
    assert [r.review_ord for r in rows.orderBy(*reports.newest_first_key()).collect()] == [1, 2, 3]


def test_sketches_of_many_values_stay_close(spark):
    from revlens.operators import facets
    rows = spark.range(60000).select(F.col("id"), F.concat(F.lit("2025-W0"), F.col("id") % 3 + 1).alias("week"), F.lit("2025-01-01").cast("date").alias("review_day"),
                                     F.concat(F.lit("user"), F.col("id") % 20000).alias("author"))
    halves = [facets.weekly_sketches(rows.where(F.col("id") % 2 == i)) for i in (0, 1)]
    merged = {r.week: r for r in facets.merge_sketches(*halves, by=["week"]).collect()}
    exact = {r.week: r.n for r in rows.groupBy("week").agg(F.count_distinct("author").alias("n")).collect()}
    assert all(merged[w].n_reviews == 20000 and abs(merged[w].n_distinct / exact[w] - 1) < 0.05 for w in exact)
    one = facets.merge_sketches(*halves).first()
    assert one.n_reviews == 60000 and abs(one.n_distinct / 20000 - 1) < 0.05


def test_pivot_with_a_given_list_of_channels(spark):
    from revlens.operators import facets
    rows = spark.createDataFrame([("A", "X"), ("A", "Y"), ("B", "Z")], "model_id string, channel string")
    out = facets.model_channel_pivot(rows, ["X", "W"])
    assert out.columns == ["model_id", "X", "W", "total"] and {tuple(r) for r in out.collect()} == {("A", 1, 0, 2), ("B", 0, 0, 1)}


@pytest.mark.parametrize("query", ["extract_reviews_target", "classify_fallback", "captured_pages"])
def test_workers_need_no_installed_copy(query):
    """Python tasks run in a folder where the library cannot be imported by its name."""
    run = ("import sys, tempfile\n"
           f"sys.path.insert(0, {ROOT!r})\n"
           "from revlens.session import get_spark\n"
           "import __spark_entry__ as E\n"
           "spark = get_spark('local[2]', 2, extra_conf={'spark.checkpoint.dir': tempfile.mkdtemp()})\n"
           f"print('rows', E.queries()[{query!r}](spark, {SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", run], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_many_small_pages_need_few_tasks(spark, tmp_path):
    for i in range(900):
        (tmp_path / f"m{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"m{i % 3}" / f"p{i}.html").write_text(f"<p>{i}</p>")
    pages = read_captured_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.html for r in pages.collect()) == sorted(f"<p>{i}</p>" for i in range(900))
