"""Label pipeline: requests, responses, validation, caches, pluggable scorers
(C2-C5, J1-J3, W8, F16, F30, S13).

A batch scorer is a plain pandas function run by ``mapInPandas`` on many batches in
parallel; requests and responses are tables, so a response set produced elsewhere can
be parsed and validated by the same jobs.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.text import excerpt, json_array_slice, review_key, unescape_json_text
from revlens.operators.classify import constant
from revlens.operators.sequence import sequence_wide
from revlens.schema import ORD

# Default labels when an answer is missing or invalid.
OTHER = "Other"
PLEASE_COMMENT = "Please add comments"
REASON_MISSING = "API 未返回有效分类结果"
REASON_BAD_PRIMARY = "返回的一级分类不在分类表中"
REASON_BAD_SECONDARY = "返回的二级分类不在分类表中"
REASON_UNPARSABLE = "API 返回格式异常，未能稳定解析分类结果"
REASON_RECOVERED = "API 返回格式已修复"

ANSWER_SCHEMA = "array<struct<id:bigint,primary:string,secondary:string,reason:string>>"


def request_items(low: DataFrame, batch_size: int = 3) -> DataFrame:
    """C2 rows: one item per low review with a global id and its batch."""
    items = sequence_wide(low, [F.col(ORD).asc()], (), "_seq")
    return (items.withColumn("item_id", F.col("_seq") - 1)
            .withColumn("batch_id", F.floor((F.col("_seq") - 1) / batch_size).cast("bigint"))
            .withColumn("cache_key", review_key())
            .drop("_seq"))


def item_struct() -> Column:
    return F.struct(
        F.col("item_id").alias("id"), F.col("cache_key").alias("cache_id"),
        F.coalesce(F.col("model_name"), F.lit("")).alias("model"),
        F.coalesce(F.col("channel"), F.lit("")).alias("channel"),
        F.coalesce(F.col("rating"), F.lit("")).alias("rating"),
        F.coalesce(F.col("review_date"), F.lit("")).alias("date"),
        excerpt("title", 160).alias("title"), excerpt("review_text", 900).alias("review"),
        excerpt("issue_summary", 260).alias("summary"))


def taxonomy_map(specs) -> Column:
    """category -> phrases (in order) as a literal map; later duplicates of a category are merged."""
    merged: dict = {}
    for s in specs:
        merged.setdefault(s["category"], []).append(s["phrase"])
    return constant(merged, "map<string,array<string>>")


def classify_requests(items: DataFrame, specs) -> DataFrame:
    """One JSON payload per batch: the taxonomy and the batch's reviews in id order."""
    per_batch = items.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(item_struct())).alias("reviews"))
    return per_batch.select(
        "batch_id", F.size("reviews").cast("bigint").alias("n_items"),
        F.array_join(F.transform("reviews", lambda r: r["id"].cast("string")), ",").alias("item_ids"),
        F.to_json(F.struct(taxonomy_map(specs).alias("taxonomy"), F.col("reviews"))).alias("payload"))


def _recovered(objects: Column) -> Column:
    """Regex recovery of answer objects from a text that is not valid JSON."""
    def one(o):
        trimmed = F.regexp_replace(o, r"\}$", "")
        reason = F.regexp_extract(trimmed, r'(?s)"reason"\s*:\s*"(.*)"\s*$', 1)
        return F.struct(
            F.nullif(F.regexp_extract(o, r'"id"\s*:\s*(\d+)', 1), F.lit("")).try_cast("bigint").alias("id"),
            F.regexp_extract(o, r'"primary"\s*:\s*"([^"]*)"', 1).alias("primary"),
            F.regexp_extract(o, r'"secondary"\s*:\s*"([^"]*)"', 1).alias("secondary"),
            F.when(reason != "", unescape_json_text(reason)).otherwise(F.lit(REASON_RECOVERED)).alias("reason"),
            (o.rlike(r'"id"\s*:\s*\d+') & o.rlike(r'"primary"\s*:\s*"') & o.rlike(r'"secondary"\s*:\s*"')).alias("ok"))
    return F.transform(F.filter(F.transform(objects, one), lambda s: s["ok"]),
                       lambda s: F.struct(s["id"].alias("id"), F.trim(s["primary"]).alias("primary"),
                                          F.trim(s["secondary"]).alias("secondary"), s["reason"].alias("reason")))


def parse_label_responses(responses: DataFrame) -> DataFrame:
    """C3 + F16: (batch_id, content) -> (batch_id, id, primary, secondary, reason, pos, status).

    Strict JSON first; when that fails, answer objects are recovered by regex; when
    nothing is recovered, ``status`` = 'unparsable' and the batch gets no answers
    (J2 then fills the defaults)."""
    arr = json_array_slice("content")
    parsed = responses.select("batch_id", arr.alias("_arr")).withColumn("_strict", F.from_json("_arr", ANSWER_SCHEMA))
    objects = F.regexp_extract_all(F.coalesce("_arr", F.lit("")), F.lit(r"(?s)(\{.*?\})"), 1)
    rec = _recovered(objects)
    answers = (parsed
               .withColumn("_answers", F.when(F.col("_strict").isNotNull(), F.col("_strict")).otherwise(rec))
               .withColumn("status", F.when(F.col("_strict").isNotNull(), F.lit("json"))
                           .when(F.size(rec) > 0, F.lit("recovered")).otherwise(F.lit("unparsable"))))
    return (answers.select("batch_id", "status", F.posexplode_outer("_answers").alias("pos", "a"))
            .select("batch_id", "status", "pos", F.col("a.id").alias("id"),
                    F.col("a.primary").alias("primary"), F.col("a.secondary").alias("secondary"),
                    F.col("a.reason").alias("reason")))


def last_answer_per_id(answers: DataFrame) -> DataFrame:
    """A later answer for the same id replaces an earlier one."""
    return (answers.filter(F.col("id").isNotNull())
            .groupBy("batch_id", "id")
            .agg(F.max(F.struct("pos", "primary", "secondary", "reason")).alias("a"))
            .select("batch_id", "id", "a.primary", "a.secondary", "a.reason"))


def results_with_default(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Every request item gets its answer, or ('Other', 'Please add comments', reason).

    One row per batch carries its last answers and whether it could be parsed, so a single
    join on the batch (a few items) serves both."""
    last = F.struct("pos", "primary", "secondary", "reason")
    per_id = answers.groupBy("batch_id", "id").agg(F.max(F.when(F.col("id").isNotNull(), last)).alias("a"), F.max(F.col("status") == "unparsable").alias("bad"))
    batches = per_id.groupBy("batch_id").agg(
        F.max("bad").alias("_bad"),
        F.map_from_entries(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "a")))).alias("_answers"))
    out = items.join(batches, "batch_id", "left").withColumn("_a", F.try_element_at("_answers", F.col("item_id")))
    for c in ("primary", "secondary", "reason"):
        out = out.withColumn(c, F.col("_a." + c))
    out = out.drop("_a", "_answers")
    default_reason = F.when(F.col("_bad"), F.lit(REASON_UNPARSABLE)).otherwise(F.lit(REASON_MISSING))
    answered = F.col("primary").isNotNull()
    return (out.withColumn("reason", F.when(answered, F.coalesce("reason", F.lit(""))).otherwise(default_reason))
            .withColumn("secondary", F.when(answered, F.coalesce("secondary", F.lit(""))).otherwise(F.lit(PLEASE_COMMENT)))
            .withColumn("primary", F.coalesce("primary", F.lit(OTHER)))
            .drop("_bad"))


def fallback_secondary(specs) -> str:
    """Secondary used with 'Other': 'Please add comments' if listed under Other, else
    Other's first phrase, else 'Other'."""
    other = [sp["phrase"] for sp in specs if sp["category"] == OTHER]
    return PLEASE_COMMENT if PLEASE_COMMENT in other else (other[0] if other else OTHER)


def validate_labels(df: DataFrame, specs, primary="primary", secondary="secondary", reason="reason") -> DataFrame:
    """(primary, secondary) must exist in the taxonomy; otherwise 'Other' with the
    fallback secondary, keeping a given reason or stating the failure.

    The taxonomy is configuration, so the membership tests are lookups in constant arrays
    inside the projection - no join."""
    cats = constant(list(dict.fromkeys(sp["category"] for sp in specs)), "array<string>")
    pairs = constant([sp["category"] + "\u0001" + sp["phrase"] for sp in specs], "array<string>")
    p = F.trim(F.coalesce(F.col(primary), F.lit("")))
    s = F.trim(F.coalesce(F.col(secondary), F.lit("")))
    r = F.trim(F.coalesce(F.col(reason), F.lit("")))
    bad_p = ~F.array_contains(cats, p)
    bad_s = ~F.array_contains(pairs, F.concat(p, F.lit("\u0001"), s))
    fb = F.lit(fallback_secondary(specs))
    return (df.withColumn(reason, F.when(bad_p, F.when(r != "", r).otherwise(F.lit(REASON_BAD_PRIMARY)))
                          .when(bad_s, F.when(r != "", r).otherwise(F.lit(REASON_BAD_SECONDARY)))
                          .otherwise(r))
            .withColumn("_ok", ~(bad_p | bad_s))
            .withColumn(secondary, F.when(F.col("_ok"), s).otherwise(fb))
            .withColumn(primary, F.when(F.col("_ok"), p).otherwise(F.lit(OTHER)))
            .drop("_ok"))


def cache_hit_miss(items: DataFrame, cache: DataFrame, key: str = "cache_key"):
    """(hits with cached labels, misses still to score) by a hash join on the key."""
    looked = items.join(cache.withColumn("_hit", F.lit(True)), key, "left")
    return looked.filter("_hit").drop("_hit"), looked.filter("_hit is null").select(*items.columns)


def with_hits(items: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """J1 in one join: every item with the cached labels and ``hit`` (0 or 1)."""
    return (items.join(cache.withColumn("_hit", F.lit(1)), key, "left")
            .withColumn("hit", F.coalesce("_hit", F.lit(0))).drop("_hit"))


BatchScorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with_function(items: DataFrame, fn: BatchScorer) -> DataFrame:
    """C4: run a pandas batch scorer on every request batch in parallel.

    ``fn`` gets the rows of one batch (``item_id``, ``title``, ``review_text``,
    ``issue_summary``) and returns ``item_id, primary, secondary, reason``.  A batch
    holds at most ``batch_size`` rows, so each pandas call is small and bounded."""
    cols = ["batch_id", "item_id", "title", "review_text", "issue_summary"]

    def run(frames):
        for pdf in frames:
            for _, batch in pdf.groupby("batch_id", sort=False):
                yield fn(batch.reset_index(drop=True))[["item_id", "primary", "secondary", "reason"]]

    # items come numbered in order, so a batch's rows stand together; a batch cut by a
    # partition edge is two smaller calls
    return items.select(*cols).mapInPandas(run, "item_id long, primary string, secondary string, reason string")


TranslateFn = Callable[[list], list]


def translate_with_function(rows: DataFrame, fn: TranslateFn, cache: DataFrame | None = None,
                            text_col: str = "issue_summary", batch_size: int = 10) -> DataFrame:
    """Translate each distinct summary once (by content hash), skipping cached ones.

    A batch whose answer has the wrong length, or whose call fails, gives '' for its rows."""
    from revlens.functions.text import text_hash

    keyed = rows.withColumn("text_key", text_hash(text_col))
    distinct = keyed.groupBy("text_key").agg(F.min(F.col(text_col)).alias("text"))
    if cache is not None:
        distinct = distinct.join(cache.select("text_key"), "text_key", "left_anti")

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                try:
                    got = list(fn(part["text"].tolist()))
                    ok = len(got) == len(part)
                except Exception:  # noqa: BLE001 - a failed batch gives ''
                    got, ok = [], False
                yield pd.DataFrame({"text_key": part["text_key"].values,
                                    "translated": [str(g) for g in got] if ok else [""] * len(part)})

    fresh = distinct.mapInPandas(run, "text_key string, translated string")
    known = fresh if cache is None else fresh.unionByName(cache.select("text_key", "translated"))
    return keyed.join(known, "text_key", "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def message_text(resp) -> Column:
    """text of the first choice of a chat-style response: the content string, or the
    text parts (type 'text' / 'output_text') of a content list joined by newlines.
    NULL when there is none (the caller reports that as a status)."""
    from revlens.functions.text import col_of, py_strip
    v = F.try_parse_json(col_of(resp))
    path = "$.choices[0].message.content"
    parts = F.try_variant_get(v, path, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "output_text")
                                               & (py_strip(F.coalesce(p["text"], F.lit(""))) != "")),
                                      lambda p: p["text"]), "\n")
    text = F.when(parts.isNotNull(), py_strip(joined)).otherwise(py_strip(F.try_variant_get(v, path, "string")))
    return F.nullif(text, F.lit(""))


def as_chat_response(content, parts_form) -> Column:
    """Wrap answer text the way a chat API returns it (string content, or a list of parts)."""
    from revlens.functions.text import col_of
    c = col_of(content)
    as_parts = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), c.alias("text"))).alias("content")).alias("message"))).alias("choices")))
    as_text = F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices")))
    return F.when(parts_form, as_parts).otherwise(as_text)
