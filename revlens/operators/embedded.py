"""Reviews and ratings in the JSON scripts of captured pages.

A script is parsed to a VARIANT and unfolded inside its row: every step adds the objects and
arrays one level deeper, and the deepest script gives the number of steps, so nothing is
written between levels.  What a record takes from its object is then read from the object's
own members: for each field the member whose key stands first in the field's key list.
Places are arrays of positions, so comparing them gives the order of a walk from the top;
members of one object are visited in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revlens.functions.ratings import normalize_rating_text, overall_rating_text
from revlens.functions.text import clean_text
from revlens.operators.extract import markup_rating, once
from revlens.operators.records import drop_badge_only
from revlens.session import materialize, written

# Keys that mark a review object, and the keys of each field in priority order.
TEXT_KEYS = ["reviewtext", "review_text", "reviewbody", "body", "text", "comments", "description"]
RATING_KEYS = ["rating", "reviewrating", "ratingvalue", "stars"]
ID_KEYS = ["reviewid", "review_id", "id"]
FIELD_KEYS = {
    "review_text": ["reviewtext", "review_text", "reviewbody", "body", "text", "comments", "description"],
    "title": ["reviewtitle", "title", "summary", "name"],
    "rating": ["rating", "reviewrating", "ratingvalue", "stars"],
    "author": ["usernickname", "nickname", "author", "username", "name"],
    "review_date": ["submissiontime", "submitteddate", "createddate", "datepublished", "date"],
    "verified": ["badges", "syndicationsource", "verifiedpurchaser"],
}
NESTED_TEXT_KEYS = ["text", "name", "value", "label"]
NESTED_RATING_KEYS = ["ratingValue", "value", "rating"]


STEPS = 8  # levels unfolded in one go; deeper scripts go on from the stored rows


def page_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, script_no, script): the trimmed, non-empty script bodies of every page."""
    scripts = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), 1)
    return (pages.select("page_id", F.posexplode(scripts).alias("script_no", "script"))
            .withColumn("script", F.regexp_replace("script", r"^\s+|\s+$", "")).filter("script <> ''"))


def _depth(json: Column) -> Column:
    """How deep the brackets outside the strings of a JSON text are nested."""
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*+"', ""), r"[^\[\]{}]++", "")

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.regexp_extract_all(brackets, F.lit(r"[\[\]{}]"), F.lit(0)), start, step, lambda acc: acc["most"])


def stored_scripts(pages: DataFrame) -> DataFrame:
    """``page_scripts`` of every page, stored, with the ``depth`` of those that are JSON objects or
    arrays (else null)."""
    json = F.substring("script", 1, 1).isin("{", "[") & F.try_parse_json("script").isNotNull()
    return written(page_scripts(pages).withColumn("depth", F.when(json, _depth(F.col("script")))), "scripts")


def json_objects(scripts: DataFrame) -> DataFrame:
    """Every object, at any depth, of ``stored_scripts``: (page_id, script_no, place, members), members
    being an array of (key, value) in key order.  ``place`` is an array of positions; an
    aggregateRating member is placed before its siblings."""
    steps = (scripts.agg(F.max("depth")).first()[0] or 1) - 1
    rows = scripts.filter("depth is not null").select(
        "page_id", "script_no", F.expr("cast(array() as array<int>)").alias("place"), F.try_parse_json("script").alias("value"), F.lit(True).alias("open"))
    position = "concat(place, array(if(e.key = 'aggregateRating', -1, i)))"
    inside = "x -> schema_of_variant(x.value) like 'OBJECT<%' or schema_of_variant(x.value) like 'ARRAY<%'"
    members = f"transform(map_entries(try_variant_get(value, '$', 'map<string,variant>')), (e, i) -> struct({position} as place, e.value as value, true as open))"
    items = "transform(try_variant_get(value, '$', 'array<variant>'), (v, i) -> struct(concat(place, array(i)) as place, v as value, true as open))"
    deeper = f"if(open, filter(coalesce({members}, {items}, array()), {inside}), array())"
    for done in range(steps):
        if done and done % STEPS == 0:
            rows = materialize(rows)
        rows = rows.select("page_id", "script_no", F.expr(f"explode(concat(array(struct(place, value, false as open)), {deeper}))").alias("x")).select("page_id", "script_no", "x.*")
    found = once(rows, ("page_id", "script_no", "place"), members=F.expr("map_entries(try_variant_get(value, '$', 'map<string,variant>'))"))
    return found.filter("size(members) > 0")


def _kind(value) -> Column:
    return F.split(F.schema_of_variant(value), "<")[0]


def _scalar(json: Column) -> Column:
    """Text of a JSON scalar (strings without their quotes)."""
    return F.when(json.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), 0)).otherwise(json)


def _member(json: Column, keys, any_case: bool) -> Column:
    """Value of the first of ``keys`` in a JSON object, as text (nested ones as JSON)."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    picks = [F.element_at(F.filter(entries, _has_key(k, any_case)), -1)["value"] for k in keys]
    return F.coalesce(*[F.when(F.size(F.filter(entries, _has_key(k, any_case))) > 0, p) for k, p in zip(keys, picks)])


def _has_key(key: str, any_case: bool):
    return lambda e: (F.lower(e["key"]) if any_case else e["key"]) == key


def json_text(field: Column) -> Column:
    """text of a struct(kind, json): an object gives its text, name, value or label, an
    array its cleaned parts joined by ', ', null nothing."""
    kind, json = field["kind"], field["json"]
    parts = F.filter(F.transform(F.from_json(json, "array<string>"), clean_text), lambda t: t.isNotNull())
    return (F.when(kind == "OBJECT", clean_text(_member(json, NESTED_TEXT_KEYS, True)))
            .when(kind == "ARRAY", F.nullif(F.array_join(parts, ", "), F.lit("")))
            .when(kind != "VOID", clean_text(_scalar(json))))


def json_rating(field: Column) -> Column:
    """F10 on a struct(kind, json); an object gives its ratingValue, value or rating."""
    kind, json = field["kind"], field["json"]
    inner = _member(json, NESTED_RATING_KEYS, False)
    deeper = F.when(inner.startswith("{"), _member(inner, NESTED_RATING_KEYS, False)).otherwise(inner)
    return F.nullif(normalize_rating_text(F.when(kind == "OBJECT", deeper).when(kind != "VOID", _scalar(json))), F.lit(""))


def embedded_json_reviews(pages: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Review objects at any depth (a text key, and a rating or id key): page_id,
    script_no, item_place, rating, title, review_text, review_date, author, verified;
    objects without text and title, and badge-only ones, are dropped.  ``scripts``: the
    ``stored_scripts`` of the pages, if there are any already."""
    known = {k for keys in [TEXT_KEYS, RATING_KEYS, ID_KEYS, *FIELD_KEYS.values()] for k in keys}
    lowered = F.transform("members", lambda e, i: F.struct(F.lower(e["key"]).alias("key"), i.alias("i"), e["value"].alias("value")))
    place = ("page_id", "script_no", "place")
    objects = once(json_objects(scripts if scripts is not None else stored_scripts(pages)), place, members=F.filter(lowered, lambda e: e["key"].isin(sorted(known)))).filter("size(members) > 0")
    has = lambda keys: F.exists("members", lambda e: e["key"].isin(keys))

    def pick(keys):
        """The member of the first key there is; of keys that differ in case only the last one."""
        found = [F.element_at(F.filter("members", _has_key(k, False)), -1) for k in keys]
        return F.coalesce(*[F.when(F.exists("members", _has_key(k, False)), F.struct(F.lit(r).alias("r"), (-m["i"]).alias("p"), m["value"].alias("value"))) for r, (k, m) in enumerate(zip(keys, found))])
    rows = once(objects, place, _text=has(TEXT_KEYS), _mark=has(RATING_KEYS + ID_KEYS), **{name: pick(keys) for name, keys in FIELD_KEYS.items()})

    def ranked(name):
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct(c["r"].alias("r"), c["p"].alias("p"), F.struct(_kind(c["value"]).alias("kind"), F.to_json(c["value"]).alias("json")).alias("m")))
    rows = once(rows, (*place, "_text", "_mark"), **{name: ranked(name) for name in FIELD_KEYS})
    # rows of pages that share a page_id are one record
    records = (rows.groupBy("page_id", "script_no", F.col("place").alias("item_place"))
               .agg(F.max("_text").alias("_text"), F.max("_mark").alias("_mark"), *[F.min(name)["m"].alias(name) for name in FIELD_KEYS]).filter("_text and _mark"))
    rows = once(records, ("page_id", "script_no", "item_place"), rating=json_rating(F.col("rating")),
                **{f: json_text(F.col(f)) for f in ("title", "review_text", "review_date", "author", "verified")})
    return drop_badge_only(rows.filter(F.col("review_text").isNotNull() | F.col("title").isNotNull()))


def overall_rating(pages: DataFrame, profile_col: str = "profile", scripts: DataFrame | None = None) -> DataFrame:
    """Rating of the page's product (F11): script by script the first aggregate rating of
    its JSON, else the pattern on its text; without any, the profile's elements.  ``scripts`` as
    in ``embedded_json_reviews``."""
    scripts = scripts if scripts is not None else stored_scripts(pages)

    def get(key):
        value = F.get(F.filter("members", _has_key(key, False)), 0)["value"]
        return F.when(~_kind(value).isin("OBJECT", "ARRAY", "VOID"), _scalar(F.to_json(value)))
    objects = json_objects(scripts).filter(F.exists("members", lambda e: e["key"].isin("@type", "type")))
    typed = objects.filter(F.lower(F.coalesce(F.nullif(get("@type"), F.lit("")), get("type"))) == "aggregaterating")
    named = typed.select("page_id", "script_no", "place", *[get(k).alias(k) for k in ("ratingValue", "rating", "value")])
    value = [F.when(~F.col(k).isin("", "0", "0.0", "false"), F.col(k)) for k in ("ratingValue", "rating", "value")]
    walked = named.select("page_id", F.struct("script_no", F.lit(False).alias("text"), "place", overall_rating_text(F.coalesce(*value)).alias("r")).alias("best"))
    rx = F.regexp_extract("script", r'(?is)"aggregateRating"\s*:\s*\{.*?"ratingValue"\s*:\s*"?(\d+(?:\.\d+)?)"?', 1)
    by_text = scripts.select("page_id", F.struct("script_no", F.lit(True).alias("text"), F.expr("cast(array() as array<int>)").alias("place"), F.nullif(rx, F.lit("")).alias("r")).alias("best"))
    by_script = walked.unionByName(by_text).filter("best.r is not null").groupBy("page_id").agg(F.min("best")["r"].alias("from_script"))
    return (markup_rating(pages, profile_col).join(by_script, "page_id", "left")
            .select("page_id", F.coalesce("from_script", "from_markup").alias("overall_rating")))
