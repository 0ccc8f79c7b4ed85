"""Captured shop pages derived from the review table, one page per review.

The driver's ``pages`` hold no review markup, so every review row is laid out the way one
of four shops (by its document number) shows it: nested inner markup, line breaks, escaped
characters, hidden script text.  Its embedded JSON, feed and rating forms are made the
same way, so the extraction queries read all documents and their answers are the rows the
pages were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlens import fixtures
from revlens.schema import ORD

SHOPS = ["amazon", "bestbuy", "walmart", "target"]  # by (review_ord div 2) % 4


def escaped(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit("é"), F.lit("&eacute;"))


def inner(c: Column) -> Column:
    """Text with its first word in bold, line breaks as elements, and a hidden script."""
    t = escaped(c)
    bold = F.regexp_replace(t, r"^(\S+)(?=\s)", "<b><i>$1</i></b>")
    return F.concat(F.replace(bold, F.lit("\n"), F.lit("<br>\n")), F.lit("<script>var hidden = '<p>no</p>';</script>"))


def _part(before: str, c: str, after: str, wrap=inner) -> Column:
    return F.coalesce(F.concat(F.lit(before), wrap(F.col(c)), F.lit(after)), F.lit(""))


def shop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col(ORD) / 2)
    return (fixtures.reviews(spark, sf_dir).withColumn("page_id", F.col(ORD))
            .withColumn("profile", F.element_at(F.array(*[F.lit(s) for s in SHOPS]), (number % 4 + 1).cast("int"))))


def block(shop: str) -> Column:
    """The review block of a row in the markup of ``shop``."""
    p, plain = _part, escaped
    ident = F.concat(F.lit("R"), F.col("page_id").cast("string"))
    parts = {
        "amazon": [F.lit('<div class="a-section review" data-hook="review" id="'), ident, F.lit('">'),
                   p("<i data-hook='review-star-rating'><span class='a-icon-alt'>", "rating", "</span></i>", plain),
                   p("<a data-hook='review-title' href='#'><span>", "title", "</span></a>"), p("<span data-hook='review-date'>", "review_date", "</span>", plain),
                   p('<span class="x a-profile-name">', "author", "</span>", plain), p("<span data-hook='avp-badge'>", "verified", "</span>", plain),
                   F.when(F.col("page_id") % 3 == 0, F.lit("<div data-hook='format-strip'>Style: New | Size: 55&nbsp;inch</div>"))
                   .when(F.col("page_id") % 3 == 1, F.lit("<div class='a-row a-spacing-mini'>Color: Black</div><div class='a-row a-spacing-none'>The 43&nbsp;inch one</div>")).otherwise(F.lit("")),
                   p("<span data-hook='review-body'><span>", "review_text", "</span></span>"), F.lit("</div>")],
        "bestbuy": [F.lit("<ul class='c-reviews-list'><li class='review-item'>"), p('<div class="c-ratings-reviews"><p class="c-ratings">', "rating", "</p></div>", plain),
                    p("<h3 class='c-review-title'>", "title", "</h3>"), p("<time>", "review_date", "</time>", plain),
                    p("<div class='c-review-author'>by ", "author", "</div>", plain), p("<div class='c-review-body'><p>", "review_text", "</p></div>"), F.lit("</li></ul>")],
        "walmart": [F.lit("<li data-testid='customer-review-1'><div>"), p("<span aria-label='", "rating", " stars'></span>", lambda c: F.replace(escaped(c), F.lit("'"), F.lit("&#39;"))),
                    p("<h3>", "title", "</h3>"), p("<meta itemprop='datePublished' content='", "review_date", "'>", plain),
                    p("<span itemprop='author'>", "author", "</span>", plain), p("<div itemprop='reviewBody'><p>", "review_text", "</p></div>"), F.lit("</div></li>")],
        "target": [F.lit("<div data-test='review'>"), p("<b data-test='rating'>", "rating", "</b>", plain), p("<h4 data-test='review-title'>", "title", "</h4>"),
                   p("<i data-test='review-date'>", "review_date", "</i>", plain), p("<span data-test='review-author'>", "author", "</span>", plain),
                   p("<div data-test='review-body'>", "review_text", "</div>"), F.lit("</div>")],
        "generic": [F.lit("<div class='row' data-hook='review'>"), p("<i data-hook='review-star-rating'><span>", "rating", "</span></i>", plain), p("<span class='review-title'>", "title", "</span>"),
                    p("<span data-hook='review-date'>", "review_date", "</span>", plain), p("<span class='a-profile-name'>", "author", "</span>", plain),
                    p("<div class='review-text-content'><span>", "review_text", "</span></div>"), F.lit("</div>")],
    }
    return F.concat(*parts[shop])


def all_shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, profile, model_id): every review as a page of its shop."""
    shown = None
    for shop in SHOPS:
        here = F.col("profile") == shop
        shown = F.when(here, block(shop)) if shown is None else shown.when(here, block(shop))
    html = F.concat(F.lit("<!DOCTYPE html><html><body><nav><p>Menu</p></nav>"), shown, F.lit("<footer>End</footer></body></html>"))
    return shop_rows(spark, sf_dir).select("page_id", F.col("source_url").alias("url"), html.alias("html"), "profile", "model_id")


def shop_pages(spark: SparkSession, sf_dir: str, shop: str) -> DataFrame:
    """The pages of one shop."""
    return all_shop_pages(spark, sf_dir).filter(F.col("profile") == shop)


def other_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, site): every review as a page of a shop without a registered kind: 'target', and
    two that only the default selectors know."""
    rows = shop_rows(spark, sf_dir).withColumn("site", F.element_at(F.array(F.lit("Target "), F.lit("csc"), F.lit("new_shop")), (F.floor(F.col(ORD) / 2) % 3 + 1).cast("int")))
    shown = F.when(F.col("site") == "Target ", block("target")).otherwise(block("generic"))
    return rows.select("page_id", F.col("source_url").alias("url"), F.concat(F.lit("<html><body>"), shown, F.lit("</body></html>")).alias("html"), "site")


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose review and product rating stand in their scripts, at some depth: odd pages
    nest one level more; every fifth holds a broken script before; the review of a seventh
    is a list of text parts; ratings come as numbers, objects or text."""
    n = F.floor(F.col(ORD) / 2)
    member = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(""))
    scalar = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(member(c))
    body = F.when(n % 7 == 0, F.concat(F.lit("["), scalar("review_text"), F.lit(',"more"]'))).otherwise(scalar("review_text"))
    rating = F.when(n % 3 == 0, F.concat(F.lit('{"ratingValue":'), scalar("rating"), F.lit("}"))).otherwise(scalar("rating"))
    review = F.concat(F.lit('{"reviewId":"r'), F.col(ORD).cast("string"), F.lit('","reviewText":'), body, F.lit(',"rating":'), rating, F.lit(',"Title":{"name":'), scalar("title"),
                      F.lit('},"userNickname":'), scalar("author"), F.lit(',"submissionTime":'), scalar("review_date"), F.lit("}"))
    nested = F.when(n % 2 == 1, F.concat(F.lit('{"props":{"list":['), review, F.lit(',{"id":1,"other":2}]}}'))).otherwise(F.concat(F.lit("["), review, F.lit("]")))
    overall = F.when(n % 4 == 0, F.concat(F.lit('{"a":{"@type":"AggregateRating","ratingValue":"3"},"aggregateRating":{"@type":"aggregaterating","ratingValue":'), scalar("overall_rating"), F.lit("}}"))) \
        .otherwise(F.concat(F.lit('window.x = {"aggregateRating": {"count": 3, "ratingValue": '), scalar("overall_rating"), F.lit("}};")))
    safe = lambda c: F.replace(c, F.lit("</"), F.lit("<\\/"))
    html = F.concat(F.lit("<html><body>"), F.when(n % 5 == 0, F.lit("<script>{broken</script>")).otherwise(F.lit("")), F.lit('<script type="application/json"> '), safe(nested),
                    F.lit("\n</script><script>"), safe(overall), F.lit("</script></body></html>"))
    rows = shop_rows(spark, sf_dir)
    return rows.select("page_id", F.col("source_url").alias("url"), html.alias("html"), F.lit("walmart").alias("profile"), "model_id")
