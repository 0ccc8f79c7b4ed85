"""Crawl targets and page plans.

The target configuration is a table: one row per model with a map of site ->
(enabled, url, max_pages).  Plans are built with ``explode(sequence(...))``;
nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.markup import product_id
from revlens.functions.sites import star_filter
from revlens.functions.text import col_of, py_strip
from revlens.operators.reports import first_non_empty
from revlens.schema import ORD

SITE_SCHEMA = "struct<enabled:boolean,url:string,max_pages:int>"
# Status marks and the placeholder for a missing URL.
ENABLED_MARK, DISABLED_MARK, NO_URL_TEXT = "✓", "○", "（未填写 URL）"
# Site names and site prefixes per shop kind.
REGISTRY = {"bestbuy": "bestbuy", "bby": "bestbuy", "amazon": "amazon", "walmart": "walmart", "wmt": "walmart"}
PREFIXES = [("amazon", ["amazon_", "amz_"]), ("bestbuy", ["bby_", "bestbuy_"]), ("walmart", ["wmt_", "walmart_"])]


def targets_from_reviews(reviews: DataFrame, pages_per=10) -> DataFrame:
    """Target configuration derived from stored reviews: per model and site the first URL,
    enabled unless the channel is outside the three shops, pages = reviews / 10."""
    per_site = (reviews.groupBy("model_id", "site")
                .agg(F.min(F.struct(ORD, "source_url")).alias("_u"),
                     F.min(F.struct(ORD, "channel")).alias("_c"),
                     F.count(F.lit(1)).alias("_n")))
    site_val = F.struct(F.col("_c.channel").isin("AMZ", "BBY", "WMT").alias("enabled"),
                        F.col("_u.source_url").alias("url"),
                        F.ceil(F.col("_n") / pages_per).cast("int").alias("max_pages"))
    sites = per_site.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("site", site_val))).alias("sites"))
    names = reviews.groupBy("model_id").agg(
        F.coalesce(first_non_empty("model_name"), F.col("model_id")).alias("display_name"))
    return names.join(sites, "model_id")


def all_targets(cfg: DataFrame) -> DataFrame:
    return cfg.select("model_id", "display_name", F.explode("sites").alias("site", "t")).select(
        "model_id", "display_name", "site", F.col("t.enabled").alias("enabled"),
        F.col("t.url").alias("url"), F.col("t.max_pages").alias("max_pages"))


def scrape_targets(cfg: DataFrame) -> DataFrame:
    """Enabled targets with a non-blank URL."""
    return all_targets(cfg).filter(F.col("enabled") & (py_strip(F.coalesce("url", F.lit(""))) != ""))


def filter_targets(targets: DataFrame, model: str | None = None, site: str | None = None) -> DataFrame:
    """Model by id or display name; site exact or by family."""
    if model:
        targets = targets.filter((F.col("model_id") == model) | (F.col("display_name") == model))
    if site:
        k = site.lower()
        s = F.lower(F.col("site"))
        cond = s == k
        if k == "amazon":
            cond = cond | s.startswith("amazon") | s.startswith("amz_")
        if k in ("bestbuy", "bby"):
            cond = cond | s.startswith("bestbuy") | s.startswith("bby_")
        if k in ("walmart", "wmt"):
            cond = cond | s.startswith("walmart") | s.startswith("wmt_")
        targets = targets.filter(cond)
    return targets


def target_status(cfg: DataFrame) -> DataFrame:
    """Status mark and URL preview for every configured target."""
    t = all_targets(cfg)
    url = py_strip(F.coalesce("url", F.lit("")))
    ok = F.col("enabled") & (url != "")
    return t.select("model_id", "site", F.when(ok, F.lit(ENABLED_MARK)).otherwise(F.lit(DISABLED_MARK)).alias("status"),
                    F.when(url != "", url).otherwise(F.lit(NO_URL_TEXT)).alias("url_preview"))


def site_profile(site="site") -> Column:
    """Shop kind of a site key: exact name, then prefix, else generic."""
    key = py_strip(F.lower(col_of(site)))
    reg = F.create_map(*[x for k, v in REGISTRY.items() for x in (F.lit(k), F.lit(v))])
    expr = F.try_element_at(reg, key)
    pref = None
    for kind, ps in PREFIXES:
        cond = None
        for p in ps:
            c = key.startswith(p)
            cond = c if cond is None else cond | c
        pref = F.when(cond, F.lit(kind)) if pref is None else pref.when(cond, F.lit(kind))
    return F.coalesce(expr, pref.otherwise(F.concat(F.lit("generic:"), key)))


def set_query_params(url, updates: dict, defaults: dict | None = None) -> Column:
    """set query parameters, keeping the other ones and their order; ``defaults``
    are added only when absent.  New keys go to the end, in the given order."""
    u = col_of(url)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = F.coalesce(F.nullif(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), F.lit("")), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")) & ~p.endswith("="))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    upd = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(str(v)))])
    kept = F.transform(pairs, lambda p: F.when(F.try_element_at(upd, F.substring_index(p, "=", 1)).isNotNull(),
                                                F.concat(F.substring_index(p, "=", 1), F.lit("="),
                                                         F.url_encode(F.try_element_at(upd, F.substring_index(p, "=", 1)))))
                       .otherwise(p))
    extra = []
    for k, v in updates.items():
        val = v if isinstance(v, Column) else F.lit(str(v))
        extra.append(F.when(~F.array_contains(keys, F.lit(k)), F.concat(F.lit(k + "="), F.url_encode(val))))
    for k, v in (defaults or {}).items():
        extra.append(F.when(~F.array_contains(keys, F.lit(k)), F.lit(f"{k}={v}")))
    allp = F.concat(kept, F.filter(F.array(*extra), lambda x: x.isNotNull())) if extra else kept
    return F.concat(base, F.lit("?"), F.array_join(allp, "&"))


def page_plan(targets: DataFrame) -> DataFrame:
    """One row per (target, page) with the page URL (plan only, nothing is fetched)."""
    kind = site_profile("site")
    t = targets.withColumn("kind", kind)
    pages = F.when(F.col("kind").startswith("generic:"), F.lit(1)).otherwise(F.greatest(F.col("max_pages"), F.lit(1)))
    t = t.withColumn("page_no", F.explode(F.sequence(F.lit(1), pages)))
    n = F.col("page_no").cast("string")
    star = star_filter("site")
    amazon = set_query_params("url", {"pageNumber": n},
                              defaults={"reviewerType": "all_reviews"})
    amazon = F.when(star.isNotNull(), set_query_params(amazon, {"filterByStar": star})).otherwise(
        set_query_params(amazon, {}, defaults={"filterByStar": "all_stars"}))
    amazon = set_query_params(amazon, {}, defaults={"ie": "UTF8"})
    paged = set_query_params("url", {"page": n})
    page_url = (F.when(F.col("kind") == "amazon", amazon)
                .when(F.col("kind") == "bestbuy", F.when(F.col("page_no") <= 1, F.col("url")).otherwise(paged))
                .when((F.col("kind") == "walmart") & product_id("url", "kind").isNotNull(),
                      F.concat(F.lit("https://www.walmart.com/reviews/product/"), product_id("url", "kind"), F.lit("?page="), n, F.lit("&sort=submission-desc")))
                .when(F.col("kind") == "walmart", paged)
                .otherwise(F.col("url")))
    return t.select("model_id", "site", "kind", "page_no", page_url.alias("page_url"))


def _site_root(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*", 0)


def url_candidates(url="url", site="site", model="model_id") -> Column:
    """ordered distinct candidate URLs of a target by its shop.

    Amazon: product page, all-stars review list, the URL (without an ASIN the model id stands
    in).  Best Buy: product page, legacy review list (keeping ``ratings``), the URL.
    Walmart: product page, review list, the URL.  Others: the URL."""
    u, kind = col_of(url), site_profile(site)
    pid = product_id(u, kind)
    root, path = _site_root(u), F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    asin = F.coalesce(pid, col_of(model))
    listed = F.when(F.contains(path, F.lit("/product-reviews/")), u).otherwise(F.concat(root, F.lit("/product-reviews/"), asin, query))
    stars = set_query_params(listed, {"pageNumber": "1", "filterByStar": "all_stars", "reviewerType": "all_reviews"}, defaults={"ie": "UTF8"})
    new = r"/product/([^/]+)/[^/]+/sku/(\d+)/reviews"
    old = r"/site/reviews/([^/]+)/(\d+)"
    product = (F.when(path.rlike(new), F.concat(root, F.regexp_extract(path, r"(/product/[^/]+/[^/]+/sku/\d+)/reviews", 1)))
               .when(path.rlike(old), F.concat(root, F.lit("/site/"), F.regexp_extract(path, old, 1), F.lit("/"), F.regexp_extract(path, old, 2), F.lit(".p"))))
    ratings = F.regexp_extract(query, r"[?&]ratings=([^&]*)", 1)
    legacy = F.when(path.rlike(new), F.concat(root, F.lit("/site/reviews/"), F.regexp_extract(path, new, 1), F.lit("/"), F.regexp_extract(path, new, 2),
                                              F.when(ratings != "", F.concat(F.lit("?ratings="), ratings)).otherwise(F.lit(""))))
    found = (F.when(kind == "amazon", F.array(F.concat(F.lit("https://www.amazon.com/dp/"), asin), stars, u))
             .when(kind == "bestbuy", F.array(product, legacy, u))
             .when(kind == "walmart", F.array(F.concat(F.lit("https://www.walmart.com/ip/"), pid), F.concat(F.lit("https://www.walmart.com/reviews/product/"), pid), u))
             .otherwise(F.array(u)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
