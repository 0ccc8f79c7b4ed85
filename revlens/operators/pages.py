"""Jobs over captured pages.

A page is one row (``page_id, url, html``).  Block extraction is a native
split on ``<p>`` tags after scripts/styles are removed, so it runs inside the
JVM on every page in parallel; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.functions.markup import drop_scripts, strip_tags, unescape_entities
from revlens.functions.text import collapse_ws

# Page markers per shop.  Amazon looks for review marks in the page as it is.
AMAZON_REVIEW_MARKERS = ['data-hook="review"', "data-hook='review'", 'data-hook="review-body"',
                         "data-hook='review-body'", "customer_review-"]
AMAZON_AUTH, AMAZON_CAPTCHA, AMAZON_ROBOT = ["amazon sign-in"], ["ap_captcha", "image-captcha"], ["robot check", "not a robot"]
WALMART_REVIEW_MARKERS = ["review-card", "customerreviews", "reviewtext", '"reviews"']
WALMART_ROBOT = ["captcha", "robot", "blocked", "verify your identity", "press & hold"]


def _any(col, words):
    cond = None
    for w in words:
        c = F.contains(col, F.lit(w))
        cond = c if cond is None else cond | c
    return cond


def page_status(pages: DataFrame, kind_col: str = "kind") -> DataFrame:
    """P10: status of every captured page by the shop it was captured from.

    Amazon: review marks win, then sign-in (also by URL), captcha, robot check.  Walmart:
    review marks win, then any robot mark.  Pages of other shops are plain pages."""
    raw, low, url = F.col("html"), F.lower(F.col("html")), F.lower(F.coalesce(F.col("url"), F.lit("")))
    amazon = (F.when(_any(raw, AMAZON_REVIEW_MARKERS), F.lit("reviews"))
              .when(F.contains(url, F.lit("signin")) | _any(low, AMAZON_AUTH), F.lit("auth"))
              .when(_any(low, AMAZON_CAPTCHA), F.lit("captcha"))
              .when(_any(low, AMAZON_ROBOT), F.lit("robot")).otherwise(F.lit("page")))
    walmart = F.when(_any(low, WALMART_REVIEW_MARKERS), F.lit("reviews")).when(_any(low, WALMART_ROBOT), F.lit("robot")).otherwise(F.lit("page"))
    kind = F.col(kind_col)
    return pages.select("page_id", F.when(kind == "amazon", amazon).when(kind == "walmart", walmart).otherwise(F.lit("page")).alias("status"))


def page_blocks(pages: DataFrame, *keep) -> DataFrame:
    """Text of every <p> block with its ordinal (0-based) in the page, and the columns
    ``keep`` of its page; empty blocks dropped."""
    clean = drop_scripts(F.col("html"))
    pieces = F.split(clean, r"(?i)<p\b[^>]*>", -1)
    tail = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))

    def text(x):
        body = F.regexp_replace(x, r"(?is)</(?:p|article|body|div|section|main)>.*$", "")
        return F.trim(collapse_ws(unescape_entities(strip_tags(body))))

    blocks = pages.select("page_id", *keep, F.posexplode(F.transform(tail, text)).alias("block_no", "text"))
    return blocks.filter(F.col("text") != "")


def page_target(url) -> "F.Column":
    """Crawl target of a captured page: the host it was captured from."""
    return F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1)


def new_records_per_page(pages: DataFrame) -> DataFrame:
    """A block is new on the first page (in capture order) of its target where its
    normalised text (the whole of it, lower case) appears; per page the count of new ones.

    Pages enter with one blank entry each, so pages without blocks keep their row and the
    target needs no join."""
    tp = pages.select("page_id", "html", page_target(F.col("url")).alias("target"))
    blocks = page_blocks(tp, "target")
    first = (blocks.groupBy("target", F.xxhash64(F.lower("text")).alias("k1"), F.md5(F.lower("text").cast("binary")).alias("k2"))
             .agg(F.min("page_id").alias("page_id")).select("target", "page_id", F.lit(1).alias("n")))
    every = tp.select("target", "page_id", F.lit(0).alias("n"))
    return first.unionByName(every).groupBy("target", "page_id").agg(F.sum("n").cast("bigint").alias("n_new"))


# Pages in a row without new records that end a crawl, by source; 1 elsewhere.
CUTOFF = {"walmart": 5, "walmart_feed": 3}


def cutoff_lengths(targets: DataFrame, source_col: str = "source") -> DataFrame:
    """(target, k): the cut-off length of every (target, source) row."""
    k = F.lit(1)
    for source, n in CUTOFF.items():
        k = F.when(F.col(source_col) == source, n).otherwise(k)
    return targets.select("target", k.alias("k"))


def crawl_cutoff(per_page: DataFrame, k: int | DataFrame, order="page_id") -> DataFrame:
    """Keep the pages of each target up to the k-th page in a row without new records; ``k`` is one
    number or a table (target, k), targets without a row in it have 1.

    Pages are numbered per target by ``sequence`` (range-sorted, so a host with most of the
    pages is spread over many tasks).  The crawl stops k pages after the first page with new
    records (or the start) that is followed by k pages without: for every such place the k
    next numbers are looked up among the pages with records by an equi-join on (target,
    number).  No window runs over a target."""
    from revlens.operators.sequence import sequence

    pages = sequence(per_page, [F.col(order).asc()], ["target"], "_n")
    full = pages.filter("n_new > 0").select("target", "_n")
    last = pages.groupBy("target").agg(F.max("_n").alias("_last"))
    places = full.unionByName(last.select("target", F.lit(0).cast("bigint").alias("_n")))
    if isinstance(k, int):
        places = places.withColumn("_k", F.lit(k))
    else:
        lengths = k.groupBy("target").agg(F.max("k").alias("_k"))
        places = places.join(lengths, "target", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    ahead = places.select("target", F.col("_n").alias("_from"), "_k", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + F.col("_k"))).alias("_n"))
    goes_on = (ahead.join(full.withColumn("_full", F.lit(1)), ["target", "_n"], "left").groupBy("target", "_from")
               .agg(F.max("_full").alias("_full"), F.max("_k").alias("_k")))
    stop = goes_on.filter("_full is null").groupBy("target").agg(F.min(F.col("_from") + F.col("_k")).alias("_stop"))
    stops = (pages.select("target", F.col("_n").alias("_stop"), F.col(order).alias("stop_at"))
             .join(stop, ["target", "_stop"]).drop("_stop"))
    out = per_page.join(stops, "target", "left")
    return out.withColumn("kept", F.col("stop_at").isNull() | (F.col(order) <= F.col("stop_at"))).select(*per_page.columns, "stop_at", "kept")
