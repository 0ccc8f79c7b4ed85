"""Extraction jobs on small hand-written pages (the driver's pages carry no review markup)."""

from pyspark.sql import functions as F

from revlens.functions import dom
from revlens.operators import embedded as EM
from revlens.operators import extract as EX
from revlens.operators.pages import page_status

AMAZON = """<html><body>
<div data-hook="review" id="R1"><i data-hook="review-star-rating"><span class="a-icon-alt">4.0 out of 5 stars</span></i>
 <a data-hook="review-title"><span>Great &amp; bright</span></a>
 <span data-hook="review-date">Reviewed in the United States on May 5, 2025</span>
 <span class="a-profile-name">Ann</span>
 <span data-hook="review-body"><span>Picture is sharp.</span></span></div>
<div data-hook="review" id="R2"><i data-hook="review-star-rating"><span>1.0 out of 5 stars</span></i>
 <span data-hook="review-body"><span>Remote stopped working</span></span></div>
<script>var x = "<div data-hook='review'>fake</div>";</script>
</body></html>"""

WALMART = """<div itemprop="review"><span itemprop="ratingValue" content="2">two stars</span>
<h3>Meh</h3><p>Wi-Fi keeps dropping</p><p>second</p>
<span data-testid="review-author">Bo</span></div>
<div itemprop="review"><p>Verified Purchase</p></div>"""

JSON_PAGE = """<script type="application/json">{"props": {"data": {"reviews": [
  {"reviewId": "a1", "reviewText": "Sound is weak", "rating": {"ratingValue": 3}, "userNickname": "cy",
   "submissionTime": "2025-02-01"},
  {"id": 7, "text": "Verified Purchase"},
  {"id": 8, "reviewTitle": {"text": "Nice"}, "body": ["Good", "value"], "stars": "5"}]},
  "agg": {"@type": "AggregateRating", "ratingValue": "4.55"}}}</script>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, profile string")


def test_profiles_extract_blocks(spark):
    df = pages(spark, [(1, "u", AMAZON, "amazon"), (2, "u", WALMART, "walmart")])
    got = {(r.page_id, r.block_no): r for r in EX.extract_reviews(df).collect()}
    a = got[(1, 0)]
    assert (a.rating, a.title, a.review_text, a.author) == ("4.0", "Great & bright", "Picture is sharp.", "Ann")
    assert a.review_date.startswith("Reviewed in the United States")
    assert got[(1, 1)].review_text == "Remote stopped working" and got[(1, 1)].rating == "1.0"
    assert len([k for k in got if k[0] == 1]) == 2            # the block inside <script> is ignored
    w = got[(2, 0)]
    assert (w.rating, w.title, w.review_text, w.author) == ("2", "Meh", "Wi-Fi keeps dropping", "Bo")


def test_whole_text_and_inner_markup(spark):
    page = "<div data-hook='review'><span data-hook='review-body'>Bad <b>panel</b> and more<br>second line</span><p>not this</p></div>"
    assert EX.extract_reviews(pages(spark, [(1, "u", page, "amazon")])).first().review_text == "Bad panel and more second line"


def test_amazon_fallbacks_verified_and_size(spark):
    page = """<ul><li><a data-hook='review-title'><span>T</span></a><span data-hook="review-body"><span>B one</span></span>
      <span data-hook='avp-badge'>Verified Purchase</span><span data-hook='format-strip-linkless'>x</span><div data-hook='format-strip'>Color: red</div>
      <a class="a-size-mini a-link-normal a-color-secondary">Size: 65 inch</a></li><li id='customer'><span data-hook='review-body'>B two</span></li></ul>"""
    got = EX.extract_reviews(pages(spark, [(1, "u", page, "amazon")])).collect()
    assert [(r.block_no, r.title, r.review_text, r.verified, r.size) for r in got] == [(0, "T", "B one", "Verified Purchase", "65寸"), (1, None, "B two", None, None)]


def test_value_order_per_shop(spark):
    rating = "<span itemprop='ratingValue' content='4' aria-label='3 stars'>5</span>"
    rows = [(1, "u", f"<div itemprop='review'>{rating}<p>x</p></div>", "walmart"), (2, "u", f"<div itemprop='review'>{rating}<p class='review-body'>x</p></div>", "bestbuy")]
    assert {r.page_id: r.rating for r in EX.extract_reviews(pages(spark, rows)).collect()} == {1: "4", 2: "5"}


def test_selectors():
    page = dom.parse("<div id='a' class='x y'><p class='z' data-k='abc'>1<b>2</b></p></div><p data-k='xabc'>3</p><img data-k=abc>")
    texts = lambda s: [e.text() for e in dom.select(page, s)]
    assert texts("p") == ["1 2", "3"] and texts("#a .z") == ["1 2"] and texts("div.x.y p[data-k='abc'] b") == ["2"]
    assert texts("[data-k^='abc']") == ["1 2", ""] and texts("p[data-k*='abc']") == ["1 2", "3"] and texts("b p") == []


def test_embedded_json_any_depth(spark):
    df = pages(spark, [(3, "u", JSON_PAGE, "walmart"), (4, "u", "<script>{broken</script><script>[]</script>", "walmart")])
    got = sorted(EM.embedded_json_reviews(df).collect(), key=lambda r: r.item_place)
    assert [(r.review_text, r.rating, r.author) for r in got] == [("Sound is weak", "3", "cy"), ("Good, value", "5", None)]
    assert got[1].title == "Nice"                              # badge-only object (id 7) dropped


def test_overall_rating_sources(spark):
    df = pages(spark, [(3, "u", JSON_PAGE, "x"),
                       (4, "u", '<script>x = {"aggregateRating": {"ratingValue": "4.2"}}</script>', "x"),
                       (5, "u", '<div class="rating-average">15 reviews, 4.2 out of 5</div>', "bestbuy"),
                       (6, "u", "<p>nothing</p>", "bestbuy"),
                       (7, "u", '<script>{"a":{"@type":"AggregateRating","ratingValue":3},"aggregateRating":{"@type":"AggregateRating","ratingValue":4.5}}</script>', "x"),
                       (8, "u", '<script>{"@type":"AggregateRating","ratingValue":"99"}</script><script>[{"type":"AggregateRating","rating":"2"}]</script>', "x")])
    got = {r.page_id: r.overall_rating for r in EM.overall_rating(df).collect()}
    assert got == {3: "4.5", 4: "4.2", 5: "1", 6: None, 7: "4.5", 8: "2"}


def test_feed_to_markup(spark):
    rows = [('var materials = {"a": "<div class=\\"review\\">x<\\/div>", "b": "&lt;p&gt;"};', '<div class="review">x</div>\n<p>'),
            ('f("no", "<div class=\\"BVRRReview\\">a \\u00e9 &amp; b<\\/div>");', '<div class="BVRRReview">a é & b</div>'), ("plain &lt;", "plain <")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "js string")
    assert [r[0] for r in df.select(EX.feed_to_markup(F.col("js"))).collect()] == [b for _, b in rows]


def test_source_precedence(spark):
    rows = [("A", "s", 1, "feed"), ("A", "s", 2, "page"), ("B", "s", 2, "page"), ("B", "s", 3, "browser")]
    df = spark.createDataFrame(rows, "model_id string, site string, source_rank int, src string")
    got = sorted((r.model_id, r.src) for r in EX.source_precedence(df).collect())
    assert got == [("A", "feed"), ("B", "page")]


def test_page_status_by_shop(spark):
    rows = [(1, "https://x/ap/signin", "<p>hi</p>", "amazon"), (2, "u", "<div data-hook=\"review\">robot check</div>", "amazon"),
            (3, "u", "Enter the characters: ap_captcha", "amazon"), (4, "u", "Press & Hold to confirm", "walmart"), (5, "u", "<p>blocked</p>", "amazon"),
            (6, "u", "review-card blocked", "walmart"), (7, "u", "robot", "target")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    got = {r.page_id: r.status for r in page_status(df).collect()}
    assert got == {1: "auth", 2: "reviews", 3: "captcha", 4: "robot", 5: "page", 6: "reviews", 7: "page"}


def test_saved_pages_job(spark, tmp_path):
    import os
    from revlens.plans.saved_pages import saved_pages_reviews
    d = tmp_path / "A7"
    d.mkdir()
    p = lambda body, n: f'<div itemprop="review"><span itemprop="ratingValue" content="{n}"></span><p>{body}</p></div>'
    (d / "page10.html").write_text(p("late copy", 1) + p("only on ten", 2))
    (d / "page2.html").write_text(p("late copy", 1))
    (d / "page1.htm").write_text(p("first", 5))
    (d / "notes.txt").write_text(p("not a page", 3))
    got = saved_pages_reviews(spark, str(tmp_path)).collect()
    by_text = {r.review_text: r for r in got}
    assert set(by_text) == {"first", "late copy", "only on ten"}
    assert by_text["late copy"].source_url.endswith("page2.html")   # page2 comes before page10
    (d / "page3.html").write_text(p("markup loses", 1) + '<script>[{"id": 1, "text": "from json", "stars": 4}]</script>')
    assert "from json" in {r.review_text for r in saved_pages_reviews(spark, str(tmp_path)).collect()} - {"markup loses"}


def test_block_ids_and_variant_b_key(spark):
    from revlens.operators.dedupe import keep_first_by
    from revlens.plans.saved_pages import block_record_key
    df = pages(spark, [(1, "u", AMAZON, "amazon"), (2, "u", AMAZON, "amazon")])
    recs = EX.extract_reviews(df)
    assert sorted(r.block_id for r in recs.filter("page_id = 1").collect()) == ["R1", "R2"]
    ordered = recs.withColumn("review_ord", F.struct("page_id", "block_no"))
    assert keep_first_by(ordered, block_record_key()).count() == 2   # same ids on page 2 are repeats


def nested(depth):
    return '<script>{"a":[1,{"b":' + "[" * depth + '{"id":1,"text":"deep \\" [ { text","Rating":"2","rating":"3"}' + "]" * depth + "}]}</script>"


def test_embedded_json_needs_no_job_per_level(spark):
    jobs = []
    for depth in (1, 4):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        got = EM.embedded_json_reviews(pages(spark, [(1, "u", nested(depth), "x")])).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}")))
        assert [(r.review_text, r.rating) for r in got] == [('deep " [ { text', "3")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_embedded_json_deeper_than_one_go(spark):
    rows = [(1, "u", nested(3 * EM.STEPS), "x"), (2, "u", nested(0) + "<script>{[}</script>", "x"), (None, "u", nested(1), "x")]
    got = {r.page_id: (r.review_text, r.script_no, r.item_place) for r in EM.embedded_json_reviews(pages(spark, rows)).collect()}
    text = 'deep " [ { text'
    assert got == {1: (text, 0, [0, 1, 0] + [0] * 3 * EM.STEPS), 2: (text, 0, [0, 1, 0]), None: (text, 0, [0, 1, 0, 0])}


def test_embedded_json_of_a_repeated_page(spark):
    other = JSON_PAGE.replace("Sound is weak", "Sound is fine")
    got = EM.embedded_json_reviews(pages(spark, [(3, "u", JSON_PAGE, "x"), (3, "v", JSON_PAGE, "x"), (3, "w", other, "x")])).collect()
    assert sorted(r.review_text for r in got) == ["Good, value", "Sound is fine"]
