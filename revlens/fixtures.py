"""Review rows derived from the driver's ``documents`` table (FIXTURES.md §2-3).

The derivation is a plain projection of ``documents`` (plus one copy of every
tenth row, changed only in case and blanks), so the review table grows with
the documents table and every query built on it runs over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.functions.sites import channel
from revlens.session import spread

# Fixed values of the fixture (FIXTURES.md §2), listed by d % len(list).
MODEL_IDS = ["A7", "B7", "32H1", "43H1", "C8", "D9 Pro"]
MODEL_NAMES = ["A7", "B7 Series", "32H1", "43H1", "", "D9 Pro"]
SITES = ["amazon_5", "amazon_1", "AMZ_3", "bby_55", "bby_65", "bestbuy", " wmt ",
         "walmart_x", "target", "csc", "bby_85"]
RATINGS = ["5.0 out of 5 stars", "1.0 out of 5 stars", "3", "2.5", "4.0 out of 5 stars",
           None, "no rating", "10 points", "1"]
SUFFIXES = [" The remote stopped working.", " Wi-Fi keeps dropping.", " Dead pixel on the panel.",
            " Customer service refused a refund.", " Box arrived damaged.",
            " Sound and audio are weak.", " Firmware update failed."]

# The fixture taxonomy (FIXTURES.md §3), categories and phrases in order.
FIXTURE_TAXONOMY = [
    ("Picture", ["dead pixel", "panel lines", "no picture at all"]),
    ("Remote", ["remote stopped working", "voice remote pairing"]),
    ("Network", ["Wi-Fi", "keeps dropping connection"]),
    ("Service", ["customer service", "refund"]),
    ("Shipping", ["arrived damaged", "box"]),
    ("Audio", ["sound", "audio"]),
    ("OTA", ["update failed"]),
    ("Other", ["Please add comments"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, idx) -> "F.Column":
    return F.array(*[F.lit(v).cast("string") for v in values])[idx]


def _source_url(d, source):
    """One page address per shop form, by site (d % 11)."""
    number, tail = (d + 1000000).cast("string"), F.concat(F.lit("?ratings="), (d % 5 + 1).cast("string"))
    asin = F.concat(F.lit("B0"), F.lpad(d.cast("string"), 8, "0"))
    amazon, bby, wmt = "https://www.amazon.com", "https://www.bestbuy.com", "https://www.walmart.com"
    forms = [
        (F.lit(amazon + "/product-reviews/"), asin, F.lit("/ref=cm"), tail, F.lit("&pageNumber=3")),
        (F.lit(amazon + "/Some-TV/dp/"), F.lower(asin), tail),
        (F.lit(amazon + "/portal/customer-reviews/"), asin, tail),
        (F.lit(bby + "/product/tv-55/AB1/sku/"), number, F.lit("/reviews"), tail, F.lit("&sort=new")),
        (F.lit(bby + "/site/reviews/tv-65/"), number, tail),
        (F.lit(bby + "/site/tv/"), number, F.lit(".p"), tail),
        (F.lit(wmt + "/ip/Some-TV/"), number, tail),
        (F.lit(wmt + "/reviews/product/"), number, tail),
        (F.lit("https://www.target.com/p/tv/-/A-"), number, tail),
        (F.lit("https://shop.example.com/product/"), source, F.lit("/sku/"), number, F.lit("/reviews"), tail),
        (F.lit(wmt + "/browse/tv"), tail),
    ]
    return F.array(*[F.concat(*f) for f in forms])[(d % 11).cast("int")]


def reviews_from_documents(docs: DataFrame) -> DataFrame:
    # The whole document is the review body; its first line is the title.  Every tenth
    # document also yields its re-scraped copy; one scan makes both rows.
    docs = spread(docs.select("doc_id", "source", "text"), "doc_id")
    d = F.col("doc_id")
    both = F.array(F.lit(False), F.lit(True))
    docs = docs.withColumn("_copy", F.explode(F.when(d % 10 == 0, both).otherwise(F.array(F.lit(False)))))
    copy = F.col("_copy")
    dd = F.date_add(F.lit("2025-01-01").cast("date"), (d % 400).cast("int"))
    suffix = _pick(SUFFIXES + [""] * (12 - len(SUFFIXES)), (d % 12).cast("int"))
    badge = d % 31 == 7  # rows that hold a badge text and nothing else
    title = (F.when(badge | (d % 13 == 0), F.lit(None).cast("string"))
             .when(d % 13 == 1, F.lit("1.0 out of 5 stars"))
             .when(d % 13 == 2, F.lit("My 55 inch set"))
             .otherwise(F.split(F.col("text"), "\n", 2)[0]))
    body = (F.when(badge, F.lit("Verified Purchase"))
            .when(d % 17 == 0, F.lit(None).cast("string"))
            .when(d % 17 == 1, F.lit(" "))
            .otherwise(F.concat(F.col("text"), suffix)))
    rows = docs.select(
        (d * 2 + F.when(copy, 1).otherwise(0)).alias("review_ord"),  # a copy follows its original; unique at any size
        _pick(MODEL_IDS, (d % 6).cast("int")).alias("model_id"),
        _pick(MODEL_NAMES, (d % 6).cast("int")).alias("model_name"),
        F.when(d % 19 == 0, F.lit("65寸")).alias("size"),
        _pick(SITES, (d % 11).cast("int")).alias("site"),
        _source_url(d, F.col("source")).alias("source_url"),
        F.when(d % 4 == 0, F.lit("4.3")).when(d % 23 == 0, F.lit("n/a")).alias("overall_rating"),
        F.when(~badge, _pick(RATINGS, (d % 9).cast("int"))).alias("rating"),
        F.when(copy, F.replace(title, F.lit(" "), F.lit("  "))).otherwise(title).alias("title"),
        F.when(copy, F.concat(F.replace(body, F.lit("The"), F.lit("THE")), F.lit("  "))).otherwise(body).alias("review_text"),
        F.when(badge, F.lit(None).cast("string"))
         .when(d % 5 == 0, F.concat(F.lit("Reviewed in the United States on "), F.date_format(dd, "MMMM d, yyyy")))
         .when(d % 5 == 1, dd.cast("string"))
         .when(d % 5 == 2, F.date_format(dd, "M/d/yyyy"))
         .when(d % 5 == 4, F.lit("yesterday")).alias("review_date"),
        F.when(~badge & (d % 29 != 0), F.concat(F.lit("user"), (d % 50).cast("string"))).alias("author"),
        F.when(d % 2 == 0, F.lit("Verified Purchase")).alias("verified"),
        F.when(copy, F.lit("2026-01-02T00:00:00")).otherwise(F.lit("2026-01-01T00:00:00")).alias("scraped_at"),
    )
    return rows.select("review_ord", "model_id", "model_name", "size", channel("site").alias("channel"),
                       "site", "source_url", "overall_rating", "rating", "title", "review_text",
                       "review_date", "author", "verified", "scraped_at")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review rows (with copies) in the canonical schema plus ``review_ord``."""
    return reviews_from_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def taxonomy_rows(rules=FIXTURE_TAXONOMY):
    """(category, cat_ord, phrase, phrase_ord) tuples of an ordered rule list."""
    out, k = [], 0
    for ci, (cat, phrases) in enumerate(rules):
        for ph in phrases:
            out.append((cat, ci, ph, k))
            k += 1
    return out


def taxonomy(spark: SparkSession, rules=FIXTURE_TAXONOMY) -> DataFrame:
    """The long taxonomy table (category, cat_ord, phrase, phrase_ord)."""
    return spark.createDataFrame(taxonomy_rows(rules), "category string, cat_ord int, phrase string, phrase_ord int")
