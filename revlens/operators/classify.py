"""Keyword classification into the two-level taxonomy.

Scoring rule per phrase (phrase and review text both normalised by F2):
  * phrase contained in the text (substring)      -> 8 + number of words
  * else tokens of the phrase contained in text  -> number of such tokens,
    counted only when it reaches max(1, min(2, #tokens))
Per category the first phrase with the highest score wins; over categories the
highest score wins, ties by category name.  No hit -> ('Other', 'Other').

The taxonomy is configuration.  It enters the plan as one constant array of
phrase structs.  Up to DIRECT_PATTERNS distinct phrases and tokens, one higher-order
expression scores a text against it, pattern by pattern; beyond that the substring index
of ``phrase_index`` reads every text once, whatever their number.  Both give the same
scores, without a join or a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.text import meaningful_tokens, norm_match_text, py_strip
from revlens.operators.phrase_index import pattern_count, phrase_scores

MATCH_TEXT = "_match_text"
DIRECT_PATTERNS = 64  # scans of a text that cost about as much as its way to a Python task
_PHRASE = "array<struct<category:string,phrase_ord:int,phrase:string,np:string,wc:int,tokens:array<string>,need:int>>"


def taxonomy_rows(tax: DataFrame) -> list:
    """The taxonomy rows in phrase order (read anew for every plan, so a changed file counts)."""
    rows = tax.select("category", "cat_ord", "phrase", "phrase_ord").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["phrase_ord"])


def taxonomy_specs(tax: DataFrame) -> list:
    """Phrase specs computed by Spark from the long taxonomy, in phrase order."""
    spec = tax.select(
        "category", "cat_ord", "phrase_ord", py_strip("phrase").alias("phrase"),
        norm_match_text("phrase").alias("np"),
    ).withColumn("wc", F.size(F.split("np", " "))) \
     .withColumn("tokens", meaningful_tokens("np")) \
     .withColumn("need", F.greatest(F.lit(1), F.least(F.lit(2), F.size("tokens"))))
    rows = sorted((r.asDict() for r in spec.collect()), key=lambda r: r["phrase_ord"])
    return [r for r in rows if r["np"]]


def constant(value, schema: str) -> Column:
    """A Python value as a constant of a nested type (folded once, whatever its size)."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def phrase_array(specs) -> Column:
    fields = ("category", "phrase_ord", "phrase", "np", "wc", "tokens", "need")
    return constant([{k: s[k] for k in fields} for s in specs], _PHRASE)


def match_text(title="title", body="review_text") -> Column:
    t = F.col(title) if isinstance(title, str) else title
    b = F.col(body) if isinstance(body, str) else body
    return norm_match_text(F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(b, F.lit(""))))


def _phrase_score(text: Column, phrase: Column) -> Column:
    hits = F.size(F.filter(phrase["tokens"], lambda t: F.contains(text, t)))
    return (F.when(F.contains(text, phrase["np"]), phrase["wc"] + 8)
            .when(hits >= phrase["need"], hits).otherwise(F.lit(0)))


def phrase_candidates(text: Column, specs) -> Column:
    """Array of struct(neg_score, category, phrase_ord, phrase) for the phrases that scored."""
    if pattern_count(specs) > DIRECT_PATTERNS:
        phrases = phrase_array(specs)

        def named(m):
            p = F.get(phrases, m["phrase"])
            return F.struct((-m["score"]).alias("neg_score"), p["category"].alias("category"),
                            p["phrase_ord"].alias("phrase_ord"), p["phrase"].alias("phrase"))
        return F.transform(phrase_scores(text, specs), named)
    scored = F.transform(phrase_array(specs), lambda p: F.struct(
        (-_phrase_score(text, p)).alias("neg_score"), p["category"].alias("category"),
        p["phrase_ord"].alias("phrase_ord"), p["phrase"].alias("phrase")))
    return F.filter(scored, lambda x: x["neg_score"] < 0)


def classify_keyword(df: DataFrame, tax: DataFrame, title="title", body="review_text",
                     primary="primary", secondary="secondary") -> DataFrame:
    """Adds ``primary`` and ``secondary`` (and ``score``) to every row."""
    with_text = df.withColumn(MATCH_TEXT, match_text(title, body))
    best = F.array_min(phrase_candidates(F.col(MATCH_TEXT), taxonomy_specs(tax)))
    return (with_text.withColumn("_best", best)
            .withColumn(primary, F.coalesce(F.col("_best.category"), F.lit("Other")))
            .withColumn(secondary, F.coalesce(F.col("_best.phrase"), F.lit("Other")))
            .withColumn("score", F.coalesce(-F.col("_best.neg_score"), F.lit(0)))
            .drop("_best", MATCH_TEXT))


def phrase_match(df: DataFrame, tax: DataFrame, id_col="review_ord", title="title",
                 body="review_text") -> DataFrame:
    """One row per (review, phrase) that scored, with the score."""
    texts = df.select(id_col, match_text(title, body).alias(MATCH_TEXT))
    return (texts.select(id_col, F.explode(phrase_candidates(F.col(MATCH_TEXT), taxonomy_specs(tax))).alias("m"))
            .select(id_col, F.col("m.category").alias("category"), F.col("m.phrase").alias("phrase"),
                    F.col("m.phrase_ord").alias("phrase_ord"), (-F.col("m.neg_score")).alias("score")))
