"""Label round trip on the driver's tables: requests from low reviews, answers
derived from the ``labels`` table, then parsing, defaults and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens import fixtures
from revlens.operators import labels as L
from revlens.operators.classify import taxonomy_specs
from revlens.plans.analysis import analysis
from revlens.schema import ORD

# The answer a labeller gives per (quality, toxic) label, and for an
# unlabelled review (an unknown category, which validation turns into 'Other').
ANSWERS = {
    (0, 0): ("Picture", "dead pixel"),
    (0, 1): ("Remote", "voice remote pairing"),
    (1, 0): ("Network", "Wi-Fi"),
    (1, 1): ("Service", "box"),
}
UNLABELLED = ("Sound", "loud")
BATCH = 3


def items(spark: SparkSession, sf: str) -> DataFrame:
    from revlens.session import materialize
    return materialize(L.request_items(analysis(spark, sf).low, BATCH))  # read several times below


def _answer_cols(lab: DataFrame):
    q, t = F.col("quality"), F.col("toxic")
    p = F.lit(UNLABELLED[0])
    s = F.lit(UNLABELLED[1])
    for (qq, tt), (pp, ss) in ANSWERS.items():
        hit = (q == qq) & (t == tt)
        p = F.when(hit, F.lit(pp)).otherwise(p)
        s = F.when(hit, F.lit(ss)).otherwise(s)
    return p, s


def responses(spark: SparkSession, sf: str, it: DataFrame | None = None) -> DataFrame:
    """One answer text per request batch, in five shapes by batch number, and no
    usable answer at all for every seventh batch."""
    it = it if it is not None else items(spark, sf)
    lab = fixtures.table(spark, sf, "labels").select((F.col("doc_id") * 2).alias(ORD), "quality", "toxic")
    j = it.select("batch_id", "item_id", ORD).join(lab, ORD, "left")
    p, s = _answer_cols(j)
    obj = F.concat(F.lit('{"id":'), F.col("item_id").cast("string"), F.lit(',"primary":"'), p,
                   F.lit('","secondary":"'), s, F.lit('","reason":"label '), F.col("item_id").cast("string"), F.lit('"}'))
    per = (j.select("batch_id", "item_id", obj.alias("obj"))
           .groupBy("batch_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "obj"))),
                                         lambda x: x["obj"]), ",").alias("objs"),
                F.min("item_id").alias("first_id")))
    dup = F.concat(F.lit(',{"id":'), F.col("first_id").cast("string"),
                   F.lit(',"primary":"Other","secondary":"Please add comments","reason":"dup"}'))
    b = F.col("batch_id")
    content = (F.when(b % 7 == 6, F.lit("no answer today"))
               .when(b % 5 == 0, F.concat(F.lit("["), F.col("objs"), F.lit("]")))
               .when(b % 5 == 1, F.concat(F.lit("```json\n["), F.col("objs"), F.lit("]\n```")))
               .when(b % 5 == 2, F.concat(F.lit("<think>checking</think>["), F.col("objs"), F.lit("]")))
               .when(b % 5 == 3, F.concat(F.lit("Here: ["), F.col("objs"), F.lit(",]")))
               .otherwise(F.concat(F.lit("["), F.col("objs"), dup, F.lit("]"))))
    return per.select("batch_id", content.alias("content"))


def labelled(spark: SparkSession, sf: str, validate: bool = True) -> DataFrame:
    it = items(spark, sf)
    parsed = L.parse_label_responses(responses(spark, sf, it))
    out = L.results_with_default(it, parsed)
    if validate:
        out = L.validate_labels(out, taxonomy_specs(fixtures.taxonomy(spark)))
    return out
