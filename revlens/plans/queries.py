"""Query registry: survey query name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (``documents`` through the review
fixture, ``labels``, ``pages``, ``events``) and runs over all of their rows.
Computed columns carry the same names as in the DuckDB statements of
``revlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens import fixtures
from revlens.functions import dates as D
from revlens.functions import ratings as R
from revlens.functions import text as T
from revlens.functions.size import extract_size
from revlens.operators import dedupe, reports
from revlens.operators.classify import classify_keyword, phrase_match
from revlens.operators.sequence import review_ids, sequence, sequence_wide
from revlens.plans.analysis import analysis, classified, labeled_reviews
from revlens.schema import ORD, REVIEW_COLUMNS

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- sources, projections
@query("read_reviews")
def q_read_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + P1: two stored parts (one without some columns, one more without the key columns,
    which is skipped) read back in the canonical column order."""
    from revlens.session import fresh_dir
    from revlens.sources.reviews import read_reviews
    rows = fixtures.reviews(spark, sf)
    paths = [fresh_dir(spark, "parts") for _ in range(3)]
    rows.filter(F.col(ORD) % 4 < 2).write.parquet(paths[0])
    rows.filter(F.col(ORD) % 4 >= 2).drop("verified", "overall_rating").withColumn("other", F.lit(1)).write.parquet(paths[1])
    rows.select("model_id", ORD).write.parquet(paths[2])
    return read_reviews(spark, paths).select(ORD, *REVIEW_COLUMNS)


@query("normalize_schema")
def q_normalize_schema(spark, sf):
    """Missing columns as '', extra ones dropped, fixed order."""
    from revlens.schema import normalize_schema
    return normalize_schema(fixtures.reviews(spark, sf).drop("author", "size").withColumn("other", F.lit(1)))


@query("latest_snapshot")
def q_latest_snapshot(spark, sf):
    """The newest of three stored versions of the whole table, whose rows tell the versions
    apart; a later fallback copy does not count."""
    import os
    import time
    from revlens.session import fresh_dir
    from revlens.sources.reviews import latest_snapshot
    base, rows = fresh_dir(spark, "snapshots"), fixtures.reviews(spark, sf).select(ORD, "model_id")
    for name in ("v1", "v2", "v2_deduped"):
        rows.withColumn("version", F.lit(name)).write.parquet(os.path.join(base, name))
        time.sleep(0.05)
    return spark.read.parquet(latest_snapshot(spark, base))


@query("taxonomy_long")
def q_taxonomy_long(spark, sf):
    """A wide sheet made from the first words of all documents (twenty columns, twenty
    documents a row) to the long taxonomy; a further column without a name does not count."""
    from revlens.sources.taxonomy import taxonomy_long
    d = fixtures.table(spark, sf, "documents")
    word = F.concat(F.lit("  "), F.regexp_extract("text", r"^\s*(\S+)", 1), F.lit(" "))
    wide = d.select((F.col("doc_id") / 20).cast("bigint").alias("row"), F.col("doc_id") % 20, word.alias("w")).toDF("row", "col", "w")
    wide = wide.groupBy("row").pivot("col", list(range(20))).agg(F.max("w")).toDF("row", *[f" Topic {i} " for i in range(20)])
    return taxonomy_long(wide.withColumn("Unnamed: 20", F.lit("not a phrase")), "row")


@query("lookup_cache_store")
def q_lookup_cache_store(spark, sf):
    """Two rounds of saving label entries (malformed ones in the first) and the load."""
    from revlens.session import fresh_dir
    rows = fixtures.reviews(spark, sf).select(T.review_key().alias("cache_key"), F.col("model_id").alias("primary"),
                                              F.when(F.col(ORD) % 6 != 0, F.col("site")).alias("secondary"), F.col(ORD))
    path, entries = fresh_dir(spark, "cache"), rows.drop(ORD)
    sinks.save_cache(entries.filter(rows[ORD] % 4 < 2), path)
    sinks.save_cache(entries.withColumn("secondary", F.coalesce("secondary", F.lit("second"))), path)
    return sinks.load_cache(spark, path)


@query("size_and_rating_text")
def q_size_and_rating_text(spark, sf):
    """F11 + F13 on texts made from every review."""
    r = fixtures.reviews(spark, sf).withColumn("n", F.floor(F.col(ORD) / 2))
    n = F.col("n")
    text = (F.when(n % 4 == 0, F.concat(F.lit("Style: A\u00a0| Size : "), (n % 60 + 40).cast("string"), F.lit(" inch")))
            .when(n % 4 == 1, F.concat((n % 60 + 40).cast("string"), F.lit("-Class panel")))
            .when(n % 4 == 2, F.concat(F.lit("size "), (n % 60 + 40).cast("string"), F.lit(" \u5bf8"))).otherwise(F.concat((n % 60 + 40).cast("string"), F.lit('" TV'))))
    stars = (F.when(n % 5 == 0, F.concat((n % 7).cast("string"), F.lit(".25 out of 5 stars"))).when(n % 5 == 1, F.concat(F.lit("15 reviews, 4."), (n % 10).cast("string"), F.lit(" Out Of 5")))
             .when(n % 5 == 2, F.concat(F.lit("rated "), (n % 9).cast("string"), F.lit(".50"))).when(n % 5 == 3, F.lit("no number")))
    from revlens.functions.size import extract_size_text
    return r.select(ORD, extract_size_text(text).alias("size_text"), R.overall_rating_text(stars).alias("overall_text"))


@query("record_to_row")
def q_record_to_row(spark, sf):
    """Export rows, NULL -> ''."""
    from revlens.schema import record_to_row
    return record_to_row(fixtures.reviews(spark, sf))


@query("channel")
def q_channel(spark, sf):
    """Channel per site key."""
    r = fixtures.reviews(spark, sf)
    return r.groupBy("site", "channel").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("parse_rating")
def q_parse_rating(spark, sf):
    """F8, F9, F17 on every raw rating."""
    r = fixtures.reviews(spark, sf)
    return r.select(ORD, R.parse_rating("rating").alias("rating_num"),
                    R.parse_rating_0_5("rating").alias("rating_0_5"),
                    R.rating_label(R.parse_rating_0_5("rating")).alias("rating_label"),
                    R.parse_rating("overall_rating").alias("overall_num"))


@query("low_rating")
def q_low_rating(spark, sf):
    """P5 + P4: deduped, rated, <= 3 stars."""
    a = analysis(spark, sf)
    return a.low.select(ORD, "model_id", "rating_num")


@query("norm_key")
def q_norm_key(spark, sf):
    """F1 on the text key columns."""
    r = fixtures.reviews(spark, sf)
    return r.select(ORD, *[T.norm_key(c).alias("k_" + c) for c in ("site", "title", "review_text", "review_date", "author")])


@query("norm_match_text")
def q_norm_match_text(spark, sf):
    """F2 + F3: match text of title and body, and its meaningful tokens."""
    from revlens.operators.classify import match_text
    r = fixtures.reviews(spark, sf).select(ORD, match_text().alias("match_text"))
    return r.select(ORD, "match_text",
                    F.array_join(T.meaningful_tokens("match_text"), " ").alias("tokens"))


@query("issue_summary")
def q_issue_summary(spark, sf):
    """F4 + F5 on every raw row."""
    r = fixtures.reviews(spark, sf)
    return r.select(ORD, T.excerpt("review_text", 160).alias("excerpt_160"),
                    T.issue_summary().alias("issue_summary"))


@query("text_hash")
def q_text_hash(spark, sf):
    """F6 + F7: content hash of the body and the stable review key."""
    r = fixtures.reviews(spark, sf)
    return r.select(ORD, T.text_hash("review_text").alias("text_hash"), T.review_key().alias("review_key"))


@query("review_dates")
def q_review_dates(spark, sf):
    """F20-F24 on every raw review date."""
    r = fixtures.reviews(spark, sf)
    dash = D.dashboard_date("review_date")
    return r.select(ORD, D.format_review_date("review_date").alias("review_day"),
                    D.clean_review_date("review_date").alias("clean_date"),
                    F.date_format(dash, "yyyy-MM-dd").alias("dash_day"),
                    D.iso_week_label(dash).alias("week"),
                    D.format_date_or_raw("review_date").alias("date_or_raw"))


@query("extract_size")
def q_extract_size(spark, sf):
    """F12 on low reviews (title, body and summary searched)."""
    a = analysis(spark, sf)
    return a.low.select(ORD, extract_size().alias("size_display"))


@query("safe_name")
def q_safe_name(spark, sf):
    """export names of the models."""
    r = fixtures.reviews(spark, sf)
    return r.groupBy("model_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")) \
        .select("model_id", T.safe_name("model_id").alias("part_name"), "n_rows")


# ---------------------------------------------------------------- dedupe, sets
@query("dedupe_reviews")
def q_dedupe_reviews(spark, sf):
    """Keep-first on the normalised key."""
    return dedupe.keep_first(fixtures.reviews(spark, sf))


@query("dedupe_stats")
def q_dedupe_stats(spark, sf):
    """Original / deduped / removed."""
    return dedupe.dedupe_stats(fixtures.reviews(spark, sf))


# ---------------------------------------------------------------- classification
@query("classify_keyword")
def q_classify_keyword(spark, sf):
    """C1 on low reviews."""
    a = analysis(spark, sf)
    return classify_keyword(a.low, a.taxonomy).select(ORD, "model_id", "primary", "secondary", "score")


@query("phrase_match")
def q_phrase_match(spark, sf):
    """Every (low review, phrase) pair that scores."""
    a = analysis(spark, sf)
    return phrase_match(a.low, a.taxonomy).drop("phrase_ord")


# ---------------------------------------------------------------- reports
@query("issue_counts")
def q_issue_counts(spark, sf):
    """A1 (flagship): per model, low-review count and share per category."""
    a = analysis(spark, sf)
    return reports.issue_counts(classified(a), a.taxonomy)


@query("top_issues_k")
def q_top_issues_k(spark, sf):
    """O3: top 3 categories over all models (a top-k report)."""
    a = analysis(spark, sf)
    return reports.top_issues_k(classified(a), 3)


@query("model_header")
def q_model_header(spark, sf):
    """Rated total and low count per model."""
    return reports.model_header(analysis(spark, sf).rated)


@query("channel_metrics")
def q_channel_metrics(spark, sf):
    """A2: channel rating and count per model."""
    return reports.channel_metrics(analysis(spark, sf).rated)


@query("overview")
def q_overview(spark, sf):
    """A5 on labelled low reviews."""
    return reports.overview(labeled_reviews(spark, sf))


@query("primary_summary")
def q_primary_summary(spark, sf):
    """A6 on labelled low reviews."""
    return reports.primary_summary(labeled_reviews(spark, sf))


@query("secondary_summary")
def q_secondary_summary(spark, sf):
    """A7 on labelled low reviews."""
    return reports.secondary_summary(labeled_reviews(spark, sf))


@query("detail_seq")
def q_detail_seq(spark, sf):
    """W4 + O1: 1..n per model, newest first (undated last, then row order)."""
    a = analysis(spark, sf)
    seq = sequence(a.low.select(ORD, "model_id", "review_date"),
                   reports.newest_first_key("review_date"), ["model_id"], "seq")
    return seq.select("model_id", ORD, "seq")


@query("review_ids")
def q_review_ids(spark, sf):
    """O2 + W3: template order (model, size, date desc) and ids R0001..."""
    a = analysis(spark, sf)
    low = a.low.withColumn("size", extract_size())
    order = [F.col("model_id").asc(), F.col("size").asc()] + reports.newest_first_key("review_date")
    return review_ids(low.select(ORD, "model_id", "size", "review_date"), order).select(ORD, "model_id", "size", "review_id")


# ---------------------------------------------------------------- dashboard
from revlens.operators import facets  # noqa: E402
import datetime as _dt  # noqa: E402

# Parameters of the dashboard queries (a user's facet selection).
FACET_MODELS = ["A7", "B7", "32H1", "D9 Pro"]
FACET_CHANNELS = ["AMZ", "BBY", "WMT"]
FACET_RATINGS = [1.0, 2.5, 3.0, 4.0, 5.0]
FACET_START, FACET_END = _dt.date(2025, 1, 15), _dt.date(2025, 12, 31)
TREND_MODELS = ["A7", "C8"]


DASH_COLUMNS = [ORD, "model_id", "model_name", "size", "channel", "site", "rating", "review_date"]


def _dash(spark, sf):
    # the dashboard tables read these columns only: the dedupe carries just them
    return facets.dashboard_reviews(dedupe.keep_first(fixtures.reviews(spark, sf), carry=DASH_COLUMNS))


def _filtered(spark, sf):
    return facets.facet_filter(_dash(spark, sf), FACET_MODELS, FACET_CHANNELS, FACET_RATINGS, FACET_START, FACET_END)


@query("facet_filter")
def q_facet_filter(spark, sf):
    """Rows left by a facet selection."""
    return _filtered(spark, sf).select(ORD, "model_id", "channel", "rating_num",
                                       F.date_format("review_day", "yyyy-MM-dd").alias("review_day"))


@query("semi_join_models")
def q_semi_join_models(spark, sf):
    """Issue counts of the models left by the facet selection."""
    a = analysis(spark, sf)
    return facets.semi_join_models(reports.issue_counts(classified(a), a.taxonomy), _filtered(spark, sf))


@query("model_channel_pivot")
def q_model_channel_pivot(spark, sf):
    """Model x channel counts with total."""
    return facets.model_channel_pivot(_dash(spark, sf))


@query("weekly_trend")
def q_weekly_trend(spark, sf):
    """Reviews per ISO week and model."""
    return facets.weekly_trend(_dash(spark, sf))


@query("weekly_trend_one")
def q_weekly_trend_one(spark, sf):
    """A10: the trend of chosen models."""
    return facets.weekly_trend(_dash(spark, sf), TREND_MODELS)


@query("issue_share_dashboard")
def q_issue_share_dashboard(spark, sf):
    """Category shares in percent per model, from the issue summary."""
    a = analysis(spark, sf)
    return facets.issue_share_dashboard(reports.issue_counts(classified(a), a.taxonomy))


@query("issue_top")
def q_issue_top(spark, sf):
    """Category totals over models."""
    a = analysis(spark, sf)
    return facets.issue_top(reports.issue_counts(classified(a), a.taxonomy))


@query("kpis")
def q_kpis(spark, sf):
    """Headline counts of the facet selection."""
    a = analysis(spark, sf)
    return facets.kpis(_filtered(spark, sf), classified(a).select("model_id", ORD))


@query("model_channel_rollup")
def q_model_channel_rollup(spark, sf):
    """A8, long form: model x channel counts with every margin."""
    return facets.model_channel_rollup(_dash(spark, sf))


@query("weekly_authors")
def q_weekly_authors(spark, sf):
    """A13, sketch form: the weekly sketches of two runs, stored, read back and merged per week."""
    from revlens.session import fresh_dir
    d = facets.dashboard_reviews(dedupe.keep_first(fixtures.reviews(spark, sf), carry=[ORD, "rating", "review_date", "author"]))
    path = fresh_dir(spark, "sketches")
    for run in (0, 1):
        facets.weekly_sketches(d.filter(F.floor(F.col(ORD) / 2) % 2 == run)).write.parquet(f"{path}/run={run}")
    return facets.merge_sketches(spark.read.parquet(path), by=["week"]).withColumnRenamed("n_distinct", "n_authors")


@query("facet_values")
def q_facet_values(spark, sf):
    """Values offered per facet and the date bounds."""
    return facets.facet_values(_dash(spark, sf))


@query("records_per_target")
def q_records_per_target(spark, sf):
    """Raw records per (model, site)."""
    return facets.records_per_target(fixtures.reviews(spark, sf))


# ---------------------------------------------------------------- merge, sets, sinks
from revlens.operators import merge as M  # noqa: E402
from revlens.operators.template import labeling_template  # noqa: E402
from revlens.sources import sinks  # noqa: E402
from revlens.sources.reviews import read_classified  # noqa: E402

FIRST_SCRAPE = "2026-01-01T00:00:00"


def _split(spark, sf):
    """The stored table (first scrape, two thirds of the documents) and the incoming rows
    (the rest of the first scrape plus the second scrape)."""
    raw = fixtures.reviews(spark, sf)
    stored = (F.col("scraped_at") == FIRST_SCRAPE) & (F.col(ORD) % 3 != 0)
    return raw.filter(stored), raw.filter(~stored)


@query("union_reviews")
def q_union_reviews(spark, sf):
    """Parts with differing columns."""
    existing, incoming = _split(spark, sf)
    u = M.union_reviews(existing.drop("verified", "overall_rating"), incoming)
    return u.select(ORD, "model_id", "overall_rating", "verified")


@query("new_reviews")
def q_new_reviews(spark, sf):
    """Incoming rows whose key is not stored yet."""
    existing, incoming = _split(spark, sf)
    return M.new_reviews(incoming, existing)


@query("merge_reviews")
def q_merge_reviews(spark, sf):
    """Stored + incoming, keep-first (stored rows win)."""
    existing, incoming = _split(spark, sf)
    return M.merged(existing, incoming)


@query("merge_stats")
def q_merge_stats(spark, sf):
    """Existing, added, total."""
    existing, incoming = _split(spark, sf)
    return M.merge_stats(existing, incoming)


@query("write_reviews_by_model")
def q_write_reviews_by_model(spark, sf):
    """S8 + O1: per-model folders, newest first (seq), read back."""
    from revlens.session import fresh_dir
    d = analysis(spark, sf).deduped
    seq = sequence_wide(d, reports.newest_first_key("review_date"), ["model_id"], "seq")
    path = sinks.write_reviews_by_model(seq, fresh_dir(spark, "reviews_by_model"))
    return spark.read.parquet(path).select(ORD, "model_id", "seq")


@query("write_deduped")
def q_write_deduped(spark, sf):
    """The deduped table written as a new version and read back."""
    path = sinks.write_version(analysis(spark, sf).deduped, spark, "deduped")
    return sinks.read_version(spark, path)


@query("export_filtered")
def q_export_filtered(spark, sf):
    """Facet-filtered rows exported as CSV and read back (all text)."""
    rows = _filtered(spark, sf).select(ORD, "model_id", "channel", "rating_num",
                                       F.date_format("review_day", "yyyy-MM-dd").alias("review_day"))
    path = sinks.write_version(rows, spark, "export", "csv")
    return sinks.read_version(spark, path, "csv")


@query("labeling_template")
def q_labeling_template(spark, sf):
    """S14 + O2 + W3: the template of low reviews to label."""
    return labeling_template(analysis(spark, sf).low)


@query("read_classified")
def q_read_classified(spark, sf):
    """A filled template (labels from the labels table) read back with checks."""
    tpl = labeling_template(analysis(spark, sf).low)
    labels = fixtures.table(spark, sf, "labels").select(
        (F.col("doc_id") * 2).alias(ORD), F.col("quality").cast("string").alias("_q"), F.col("toxic").cast("string").alias("_t"))
    filled = (tpl.join(labels, ORD, "left")
              .withColumn("primary_label", F.coalesce("_q", F.lit("")))
              .withColumn("secondary_label", F.coalesce("_t", F.lit(" ")))
              .drop("_q", "_t"))
    return read_classified(filled).select(ORD, "review_id", "size", "review_date", "primary_label", "secondary_label")


# ---------------------------------------------------------------- labels
from revlens.operators import labels as L  # noqa: E402
from revlens.operators.classify import taxonomy_specs  # noqa: E402
from revlens.plans import labeling  # noqa: E402


@query("batch_ids")
def q_batch_ids(spark, sf):
    """Low reviews in batches of three, numbered on the ordinals alone."""
    from revlens.operators.sequence import batch_ids
    b = batch_ids(analysis(spark, sf).low.select(ORD), [F.col(ORD).asc()], labeling.BATCH)
    return b.select(ORD, (F.col("batch_id") * labeling.BATCH + F.col("batch_pos")).alias("item_id"), "batch_id")


@query("classify_requests")
def q_classify_requests(spark, sf):
    """One JSON request per batch (taxonomy + truncated review fields)."""
    return L.classify_requests(labeling.items(spark, sf), taxonomy_specs(fixtures.taxonomy(spark)))


@query("parse_label_responses")
def q_parse_label_responses(spark, sf):
    """C3 + F16: answers parsed from the response texts (strict, recovered, unparsable)."""
    return L.parse_label_responses(labeling.responses(spark, sf))


@query("results_with_default")
def q_results_with_default(spark, sf):
    """Every request item with its last answer or the default."""
    return labeling.labelled(spark, sf, validate=False).select(ORD, "primary", "secondary", "reason")


@query("validate_labels")
def q_validate_labels(spark, sf):
    """Answers checked against the taxonomy."""
    return labeling.labelled(spark, sf).select(ORD, "primary", "secondary", "reason")


@query("cache_hit_miss")
def q_cache_hit_miss(spark, sf):
    """Items found in a label cache (built from the labelled answers of labels with
    quality = 1) and the misses still to score."""
    it = labeling.items(spark, sf)
    done = labeling.labelled(spark, sf).join(
        fixtures.table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") * 2).alias(ORD)), ORD, "left_semi")
    cache = done.select("cache_key", "primary", "secondary", "reason")
    return L.with_hits(it, cache).select(ORD, "hit", "primary")


def _demo_scorer(pdf):
    """A deterministic stand-in for a remote model: looks for two words."""
    import pandas as pd
    text = (pdf["title"].fillna("") + " " + pdf["review_text"].fillna("")).str.lower()
    primary = text.str.contains("refund").map({True: "Service", False: "Other"})
    secondary = primary.map({"Service": "refund", "Other": "Please add comments"})
    return pd.DataFrame({"item_id": pdf["item_id"], "primary": primary, "secondary": secondary,
                         "reason": "scored"})


@query("classify_with_function")
def q_classify_with_function(spark, sf):
    """C4: cache misses scored by a pandas batch function, validated, plus cache hits."""
    it = labeling.items(spark, sf)
    specs = taxonomy_specs(fixtures.taxonomy(spark))
    scored = L.score_with_function(it, _demo_scorer)
    return L.validate_labels(it.select(ORD, "item_id").join(scored, "item_id"), specs)


def _demo_translate(texts):
    return [f"[{len(t)}] {t}" for t in texts]


@query("translate_with_function")
def q_translate_with_function(spark, sf):
    """Each distinct summary translated once by a batch function."""
    low = analysis(spark, sf).low
    return L.translate_with_function(low.select(ORD, "issue_summary"), _demo_translate).select(ORD, "translated")


# ---------------------------------------------------------------- captured pages
from revlens.functions import markup as MK  # noqa: E402
from revlens.operators import pages as PG  # noqa: E402
from revlens import shop_pages as SP  # noqa: E402

CUTOFF_K = 1  # pages in a row without new records that end a crawl ("elsewhere" setting)


def _pages(spark, sf):
    return fixtures.table(spark, sf, "pages")


@query("page_blocks")
def q_page_blocks(spark, sf):
    """<p> blocks of every captured page."""
    return PG.page_blocks(_pages(spark, sf))


@query("page_status")
def q_page_status(spark, sf):
    """P10: status label of every page of the four shops and of the captured pages of other
    hosts; some are sign-in, captcha or robot pages."""
    rows = SP.all_shop_pages(spark, sf).select("page_id", "url", "html", F.col("profile").alias("kind"))
    others = _pages(spark, sf).select((-1 - F.col("page_id")).alias("page_id"), "url", "html", F.lit("generic").alias("kind"))
    rows, n = rows.unionByName(others), F.col("page_id") % 22
    mark = (F.when(n < 4, F.lit("<p>Amazon Sign-In</p>")).when(n < 8, F.lit("<img id='ap_captcha'> reviewText"))
            .when(n < 12, F.lit("Robot check: blocked")).when(n < 16, F.lit("nothing here")))
    return PG.page_status(rows.withColumn("html", F.coalesce(mark, F.col("html"))).withColumn("url", F.when(n == 12, F.lit("https://x/ap/signin")).otherwise(F.col("url"))))


@query("url_query_param")
def q_url_query_param(spark, sf):
    """F26 (+ host): parameters of the captured URLs."""
    p = _pages(spark, sf)
    return p.select("page_id", MK.url_host("url").alias("host"), MK.url_param("url", "page").alias("page"),
                    MK.url_param("url", "ref").alias("ref"))


@query("natural_sort")
def q_natural_sort(spark, sf):
    """Captured pages in natural order of their URL."""
    p = _pages(spark, sf).select("page_id", "url", MK.natural_key("url").alias("_k"))
    return sequence(p, [F.col("_k").asc(), F.col("page_id").asc()], (), "nat_rank").select("page_id", "nat_rank")


@query("dedupe_page_records")
def q_dedupe_page_records(spark, sf):
    """New (not seen on an earlier page of the same target) records per page."""
    return PG.new_records_per_page(_pages(spark, sf))


@query("crawl_cutoff")
def q_crawl_cutoff(spark, sf):
    """Pages kept before the crawl of each target stops."""
    return PG.crawl_cutoff(PG.new_records_per_page(_pages(spark, sf)), CUTOFF_K)


@query("crawl_cutoff_by_source")
def q_crawl_cutoff_by_source(spark, sf):
    """The same with the cut-off length of every target's source (5, 3 and 1 pages)."""
    per_page = PG.new_records_per_page(_pages(spark, sf))
    sources = F.array(F.lit("walmart"), F.lit("walmart_feed"), F.lit("bestbuy"))
    targets = per_page.select("target").distinct().withColumn("source", F.get(sources, F.length("target") % 3))
    return PG.crawl_cutoff(per_page, PG.cutoff_lengths(targets))


@query("captured_pages")
def q_captured_pages(spark, sf):
    """All pages written as one file each, in a folder per host, and read back."""
    from revlens.session import fresh_dir
    from revlens.sources.reviews import read_captured_pages
    folder = fresh_dir(spark, "captured")
    # making a file takes far longer than its bytes, so pages are dealt over all cores however large the scan's
    # splits are, and tasks put their own files in place (version 2) instead of the driver one by one
    dealt = _pages(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "page_id", "url")
    rows = dealt.select(MK.url_host("url").alias("host"), F.concat(F.col("page_id").cast("string"), F.lit(" "), F.coalesce("html", F.lit(""))).alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("host").text(folder)
    read = read_captured_pages(spark, folder, "*.txt")
    return read.select(F.split("html", " ", 2)[0].cast("long").alias("page_id"), F.regexp_extract("model_id", "^host=(.*)$", 1).alias("host"),
                       F.sha2(F.col("html"), 256).alias("html_sha256"))


# ---------------------------------------------------------------- crawl targets
from revlens.functions.sites import star_filter  # noqa: E402
from revlens.operators import targets as TG  # noqa: E402

FILTER_MODEL, FILTER_SITE = "B7 Series", "amazon"


def _cfg(spark, sf):
    return TG.targets_from_reviews(fixtures.reviews(spark, sf))


@query("scrape_targets")
def q_scrape_targets(spark, sf):
    """S7 (+ F14, F25, J8): enabled targets with a URL, their star filter, product id and shop profile."""
    t = TG.scrape_targets(_cfg(spark, sf))
    return t.select("model_id", "display_name", "site", "url", "max_pages",
                    star_filter("site").alias("star_filter"), MK.product_id("url", TG.site_profile("site")).alias("product_id"),
                    TG.site_profile("site").alias("profile"))


@query("filter_targets")
def q_filter_targets(spark, sf):
    """Targets of one model (by display name) on one site family."""
    t = TG.filter_targets(TG.scrape_targets(_cfg(spark, sf)), FILTER_MODEL, FILTER_SITE)
    return t.select("model_id", "site", "url")


@query("target_status")
def q_target_status(spark, sf):
    """Status and URL preview of every configured target."""
    return TG.target_status(_cfg(spark, sf))


@query("page_plan")
def q_page_plan(spark, sf):
    """X6 + F27: page URLs to capture per target."""
    return TG.page_plan(TG.scrape_targets(_cfg(spark, sf)))


@query("url_candidates")
def q_url_candidates(spark, sf):
    """candidate URLs per target, joined as text."""
    t = TG.scrape_targets(_cfg(spark, sf))
    return t.select("model_id", "site", F.array_join(TG.url_candidates(), " ").alias("candidates"))


# ---------------------------------------------------------------- streaming
from revlens.streaming import jobs as ST  # noqa: E402

STREAM_CHUNKS = 4


def _land_in_chunks(df: DataFrame, folder: str, chunks: int, on: str):
    """Split rows by ranges of ``on`` and return writers that land chunk i as new files."""
    import os
    b = df.agg(F.min(on).alias("lo"), F.max(on).alias("hi")).first()
    lo, hi = (b.lo or 0), (b.hi or 0)
    chunk = F.floor((F.col(on) - lo) * chunks / (hi - lo + 1))
    return [(lambda i=i: df.filter(chunk == i).write.parquet(os.path.join(folder, f"chunk-{i}")))
            for i in range(chunks)]


@query("stream_merge")
def q_stream_merge(spark, sf):
    """Incoming reviews arrive as files in four runs; each micro-batch is merged
    keep-first into the stored table (stored rows win).  Returns the stored table."""
    import os
    from revlens.session import fresh_dir
    existing, incoming = _split(spark, sf)
    base = fresh_dir(spark, "stream_merge")
    job = ST.StreamMerge(spark, base, bits=3)
    job.initialise(existing)
    src = os.path.join(base, "incoming")
    doc = incoming.withColumn("_doc", F.floor(F.col(ORD) / 2))  # a review and its re-scrape land together
    landers = _land_in_chunks(doc, src, STREAM_CHUNKS, "_doc")
    schema = doc.schema
    for land in landers:
        land()
        job.run(os.path.join(src, "*"), schema)
    return job.result().drop("_doc")


@query("stream_weekly")
def q_stream_weekly(spark, sf):
    """Events per ISO week and type, by a watermarked tumbling window."""
    from revlens.session import fresh_dir
    ev = fixtures.table(spark, sf, "events")
    job = ST.StreamWeekly(spark, fresh_dir(spark, "stream_weekly"))
    job.run(sf, ev.schema, "event_type", glob="events.parquet")
    return job.result("event_type")


@query("stream_dedupe")
def q_stream_dedupe(spark, sf):
    """The first event of every burst of (user, type), events arriving in time-ordered files."""
    import os
    from revlens.session import fresh_dir
    ev = fixtures.table(spark, sf, "events")
    job = ST.StreamDedupe(spark, fresh_dir(spark, "stream_dedupe"), ["user_id", "event_type"])
    timed = ev.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    for land in _land_in_chunks(timed, job.source, STREAM_CHUNKS, "_s"):
        land()
        job.run(timed.schema)
    job.finish(timed)
    return job.result()


@query("stream_first_seen")
def q_stream_first_seen(spark, sf):
    """T3, immediate form: one event of every (user, type), with a delay that spans all events."""
    from revlens.session import fresh_dir
    ev = fixtures.table(spark, sf, "events")
    job = ST.StreamFirstSeen(spark, fresh_dir(spark, "stream_first_seen"), ["user_id", "event_type"], "40000 days")
    timed = ev.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    for land in _land_in_chunks(timed, job.source, STREAM_CHUNKS, "_s"):
        land()
        job.run(timed.schema)
    return job.result().select("user_id", "event_type")


# ---------------------------------------------------------------- report grid, fallback taxonomy
from revlens.operators import grid as GR  # noqa: E402
from revlens.sources.taxonomy import fallback_taxonomy  # noqa: E402


def _report_grid(spark, sf):
    a = analysis(spark, sf)
    # the classified rows feed every section: materialise them once in the shared
    # checkpoint folder, which also cuts the long classification plan
    from revlens.plans.analysis import Analysis, low_reviews
    from revlens.session import materialize
    rated = materialize(a.rated)
    a = Analysis(a.raw, a.deduped, rated, low_reviews(rated), a.taxonomy)
    c = materialize(classified(a))
    summary = materialize(reports.issue_counts(c, a.taxonomy))
    places = sequence(c, reports.newest_first_key("review_date"), ["model_id"], "seq", carry=[ORD]).select(ORD, "seq")
    details = c.select("model_id", ORD, "model_name", "channel", "rating", "review_date", "secondary", "reason", "review_text").join(places, ORD)
    details = details.withColumn("review_date", D.format_review_date("review_date"))
    header = reports.model_header(a.rated).join(summary.select("model_id").distinct(), "model_id")
    metrics = reports.channel_metrics(a.rated).join(summary.select("model_id").distinct(), "model_id")
    return GR.report_grid(header, metrics, summary, details)


@query("report_tables")
def q_report_tables(spark, sf):
    """Per-model report sheets as cell grids (header, channel metrics, summary, detail)."""
    return _report_grid(spark, sf).select("sheet", "row_idx", F.array_join("cells", " | ").alias("cells"))


@query("grid_tables")
def q_grid_tables(spark, sf):
    """G1: the issue summary found again in the report grids."""
    from revlens.session import materialize
    grid = materialize(_report_grid(spark, sf))  # the written report, read back
    t = GR.grid_tables(grid, ["问题分类", "问题数", "问题占比"], ["问题分类", "问题数", "问题占比", "代表关键词"])
    return t.select(F.col("sheet").alias("model_id"), F.col("问题分类").alias("primary"),
                    F.col("问题数").cast("bigint").alias("n_issues"), F.col("问题占比").cast("double").alias("share"),
                    F.col("代表关键词").alias("keywords"))


@query("classify_fallback")
def q_classify_fallback(spark, sf):
    """C1 + A1 with the built-in taxonomy (used when no taxonomy file is given)."""
    a = analysis(spark, sf, fallback_taxonomy(spark))
    return reports.issue_counts(classified(a), a.taxonomy)


# ---------------------------------------------------------------- record filters
from revlens.operators import records as RC  # noqa: E402


@query("has_content")
def q_has_content(spark, sf):
    """Raw records with a body or a title."""
    return RC.has_content(fixtures.reviews(spark, sf)).select(ORD)


@query("drop_badge_only")
def q_drop_badge_only(spark, sf):
    """Raw records that are not badge-only."""
    return RC.drop_badge_only(fixtures.reviews(spark, sf)).select(ORD)


@query("rating_filter_match")
def q_rating_filter_match(spark, sf):
    """Raw records consistent with the rating their URL asked for."""
    return RC.rating_filter_match(fixtures.reviews(spark, sf)).select(ORD, "rating")


@query("ordered_distinct")
def q_ordered_distinct(spark, sf):
    """Per model the distinct sites in first-seen order."""
    r = fixtures.reviews(spark, sf)
    first = r.groupBy("model_id", "site").agg(F.min(ORD).alias(ORD))  # one row per distinct site
    sites = first.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(ORD, "site"))).alias("s"))
    return sites.select("model_id", F.array_join(RC.ordered_distinct(F.transform("s", lambda x: x["site"])), ",").alias("sites"))


# ---------------------------------------------------------------- extraction
from revlens.operators import extract as EX  # noqa: E402

from revlens.operators import embedded as EM  # noqa: E402


def _extract_query(shop):
    @query(f"extract_reviews_{shop}")
    def q_extract(spark, sf):
        """X1 (+ W7, P9, F19) on the shop's pages."""
        return EX.extract_reviews(SP.shop_pages(spark, sf, shop))
    return q_extract


for _shop in SP.SHOPS:
    _extract_query(_shop)


@query("extract_reviews_generic")
def q_extract_reviews_generic(spark, sf):
    """J8 + X1: pages of other shops, their profile resolved by the profile table."""
    return EX.extract_reviews(EX.with_profile(SP.other_pages(spark, sf)))


@query("embedded_json_reviews")
def q_embedded_json_reviews(spark, sf):
    """X3 + F29: reviews found in the scripts of every page."""
    return EM.embedded_json_reviews(SP.json_pages(spark, sf)).drop("script_no", "item_place")


@query("overall_rating")
def q_overall_rating(spark, sf):
    """Product rating of every page."""
    return EM.overall_rating(SP.json_pages(spark, sf))


@query("feed_to_markup")
def q_feed_to_markup(spark, sf):
    """X5 (+ F15): feeds in their three forms, back to markup."""
    r = fixtures.reviews(spark, sf).filter("review_text is not null").withColumn("n", F.floor(F.col(ORD) / 2))
    markup = F.concat(F.lit('<div class="BVRRReview">'), SP.escaped(F.replace(F.col("review_text"), F.lit("\\"), F.lit("/"))), F.lit("</div>"))
    quoted = F.regexp_extract(F.to_json(F.struct(markup.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    feed = (F.when(F.col("n") % 3 == 0, F.concat(F.lit('var materials = {"a":'), quoted, F.lit(',"b":"x"};')))
            .when(F.col("n") % 3 == 1, F.concat(F.lit('f("skip", '), quoted, F.lit(', "skip too");'))).otherwise(F.lit('just &lt;text&gt; <\\/p>')))
    return r.select(ORD, EX.feed_to_markup(feed).alias("markup"))


@query("saved_pages_job")
def q_saved_pages_job(spark, sf):
    """Saved pages of every model (JSON pages and markup pages) to de-duplicated reviews."""
    from revlens.plans.saved_pages import pages_to_reviews
    js = SP.json_pages(spark, sf).filter(F.col("page_id") % 4 < 2)  # even documents; the odd ones are Best Buy and Target pages
    markup = SP.all_shop_pages(spark, sf).filter(F.col("page_id") % 4 >= 2)
    pages = js.unionByName(markup)
    pages = pages.withColumn("file_name", F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")))
    return pages_to_reviews(pages).select("model_id", "rating", "title", "review_text", "review_date", "author", "overall_rating", "page_id")


@query("source_precedence")
def q_source_precedence(spark, sf):
    """Per model and site the rows of the best-ranked source."""
    r = fixtures.reviews(spark, sf).withColumn("source_rank", F.when(F.col(ORD) % 7 == 0, F.lit(1)).when(F.col("site").startswith("b"), F.lit(2)).otherwise(F.lit(3)))
    return EX.source_precedence(r).select(ORD, "source_rank")


def _captures(spark, sf):
    """Reviews with the source they came from, and the capture status: a feed (rank 0) that gave no rows
    answered for some sites and failed for the others; one more target was only asked."""
    r = fixtures.reviews(spark, sf).withColumn("source_rank", F.when(F.col(ORD) % 7 == 0, F.lit(1)).when(F.col("site").startswith("b"), F.lit(2)).otherwise(F.lit(3)))
    status = (r.groupBy("model_id", "site").agg(F.min(ORD).alias(ORD))
              .select("model_id", "site", F.lit(0).alias("source_rank"), F.startswith("site", F.lit("bby")).alias("answered")))
    asked = status.select("model_id", F.lit("asked only").alias("site"), F.lit(2).alias("source_rank"), F.lit(True).alias("answered")).distinct()
    return r, status.unionByName(asked)


@query("sources_used")
def q_sources_used(spark, sf):
    """Per model and site the source that counts and its rows, also where it answered without any."""
    return EX.sources_used(*_captures(spark, sf))


@query("source_precedence_status")
def q_source_precedence_status(spark, sf):
    """The rows of the source that counts, by rows and capture status."""
    r, status = _captures(spark, sf)
    return EX.source_precedence(r, status=status).select(ORD, "source_rank")


@query("carried_rating")
def q_carried_rating(spark, sf):
    """X8 + X4: the product rating that goes with every page: of the product page, else of the pages so far."""
    pages = SP.json_pages(spark, sf)
    ratings = EM.overall_rating(pages).join(pages.select("page_id", "model_id"), "page_id")
    product = fixtures.reviews(spark, sf).filter("model_id in ('A7', 'C8')").groupBy("model_id").agg(F.concat(F.lit("4."), F.count(F.lit(1)) % 10).alias("overall_rating"))
    return EX.carried_rating(ratings, product).select("page_id", "model_id", "overall_rating")


# ---------------------------------------------------------------- SQL API
@query("sql_functions")
def q_sql_functions(spark, sf):
    """§2.12: the registered SQL functions used from spark.sql over the review table."""
    from revlens.functions.sql import register_sql_functions
    register_sql_functions(spark)
    fixtures.reviews(spark, sf).createOrReplaceTempView("revlens_reviews")
    return spark.sql("""
        SELECT review_ord, norm_key(title) AS k_title, norm_match_text(review_text) AS match_text,
               parse_rating(rating) AS rating_num,
               date_format(parse_review_date(review_date), 'yyyy-MM-dd') AS review_day,
               iso_week_label(CAST(parse_review_date(review_date) AS DATE)) AS week,
               extract_size(size, site, model_id, model_name, title, review_text) AS size_display
        FROM revlens_reviews""")


@query("message_text")
def q_message_text(spark, sf):
    """answer text read back from chat-style responses (every third one as a parts list)."""
    r = labeling.responses(spark, sf)
    api = r.select("batch_id", L.as_chat_response("content", F.col("batch_id") % 3 == 0).alias("response"))
    return api.select("batch_id", L.message_text("response").alias("content"))


@query("labeled_detail")
def q_labeled_detail(spark, sf):
    """C7 detail + W4: labelled low reviews per model, newest first, numbered 1..n."""
    lab = labeled_reviews(spark, sf).select(ORD, "model_id", "size", "review_date", "primary_label", "secondary_label")
    return reports.labeled_detail_seq(lab)
