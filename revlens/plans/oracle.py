"""DuckDB statements of the registered queries (the correctness oracle).

They are written independently of the Spark code: plain SQL over the
driver's views (``documents``, ``labels``, ``pages``, ``events`` ...), with
windows where Spark uses aggregates and cross joins where Spark uses
literal expressions.  Helpers below return SQL text in DuckDB's dialect.
"""

from __future__ import annotations

from revlens import fixtures
from revlens.functions.size import SIZES
from revlens.functions.text import NO_BODY_TEXT, STOPWORDS, WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def nk(x: str) -> str:
    return "lower(" + collapse("coalesce(" + x + ", '')") + ")"


def match_norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'wi-fi', 'wifi'), '[^a-z0-9]+', ' ', 'g'))"


def rating_num(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)"


def excerpt(x: str, n: int) -> str:
    t = collapse(f"coalesce({x}, '')")
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {n - 1}) || '…' END)"


def summary(body: str = "review_text", title: str = "title") -> str:
    b, t = excerpt(body, 220), excerpt(title, 220)
    return (f"(CASE WHEN {b} <> '' THEN {b} "
            f"WHEN {t} <> '' AND NOT regexp_full_match({t}, '(?i)\\d+(?:\\.\\d+)?\\s+out of 5 stars') THEN {t} "
            f"ELSE {q(NO_BODY_TEXT)} END)")


# DuckDB strptime formats equivalent to DATE_FORMATS, same order.
_DUCK_FORMATS = {
    "yyyy-MM-dd": "%Y-%m-%d", "M/d/yyyy": "%m/%d/%Y", "MMMM d, yyyy": "%B %d, %Y",
    "MMM d, yyyy": "%b %d, %Y", "d MMMM yyyy": "%d %B %Y", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "yyyy/M/d": "%Y/%m/%d",
}


def parse_date(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, {q(_DUCK_FORMATS[f])})" for f in _DUCK_FORMATS) + ")"


def nbsp_strip(x: str) -> str:
    return strip(f"replace(CAST({x} AS VARCHAR), chr(160), ' ')")


def review_date_ts(x: str = "review_date") -> str:
    t = nbsp_strip(x)
    after = f"regexp_extract({t}, '(?i)on{WS}+(.+)$', 1)"
    return parse_date(f"(CASE WHEN {after} <> '' THEN {strip(after)} ELSE {t} END)")


def clean_date(x: str = "review_date") -> str:
    t = f"coalesce({nbsp_strip(x)}, '')"
    after = strip("regexp_extract(" + t + ", '(?is)^.*on (.*)$', 1)")
    return f"(CASE WHEN regexp_matches({t}, '(?i)on ') THEN {after} ELSE {t} END)"


def dash_date(x: str = "review_date") -> str:
    return f"CAST({parse_date(clean_date(x))} AS DATE)"


def week_label(d: str) -> str:
    return f"coalesce(strftime({d}, '%G-W%V'), '')"


def size_expr(texts=("title", "review_text", "issue_summary")) -> str:
    def grab(x, pat):
        return f"NULLIF(regexp_extract(coalesce({x}, ''), {q(pat)}, 1), '')"
    site_pat = f"(?:^|_)({SIZES})(?:$|_)"
    prefix_pat = f"(?i)^({SIZES})[A-Za-z]"
    text_pat = f"(?i)(?:^|[^0-9])({SIZES}){WS}*(?:[\"”]|inch|inches|class|吋|寸)"
    found = [grab("site", site_pat), grab("model_id", prefix_pat), grab("model_name", prefix_pat)]
    found += [grab(t, text_pat) for t in texts]
    given = f"NULLIF({strip('coalesce(size, ' + q('') + ')')}, '')"
    return f"coalesce({given}, coalesce({', '.join(found)}) || '寸', '未知')"


def channel_expr(site: str = "site") -> str:
    s = strip(f"lower({site})")
    return (f"(CASE WHEN starts_with({s}, 'amazon_') OR starts_with({s}, 'amz_') THEN 'AMZ' "
            f"WHEN starts_with({s}, 'bby_') OR starts_with({s}, 'bestbuy_') THEN 'BBY' "
            f"WHEN starts_with({s}, 'wmt_') OR starts_with({s}, 'walmart_') THEN 'WMT' "
            f"WHEN {s} IN ('amazon', 'amz') THEN 'AMZ' WHEN {s} IN ('bestbuy', 'bby') THEN 'BBY' "
            f"WHEN {s} IN ('walmart', 'wmt') THEN 'WMT' WHEN {s} = 'csc' THEN 'CSC' "
            f"ELSE upper({site}) END)")


def reviews_cte() -> str:
    f = fixtures
    suffixes = f.SUFFIXES + [""] * (12 - len(f.SUFFIXES))
    return f"""
reviews_base AS (
  SELECT 2 * d AS review_ord,
    {lst(f.MODEL_IDS)}[d % 6 + 1] AS model_id,
    {lst(f.MODEL_NAMES)}[d % 6 + 1] AS model_name,
    CASE WHEN d % 19 = 0 THEN '65寸' END AS size,
    {lst(f.SITES)}[d % 11 + 1] AS site,
    [am || '/product-reviews/' || asin || '/ref=cm' || tail || '&pageNumber=3', am || '/Some-TV/dp/' || lower(asin) || tail,
     am || '/portal/customer-reviews/' || asin || tail, bb || '/product/tv-55/AB1/sku/' || num || '/reviews' || tail || '&sort=new',
     bb || '/site/reviews/tv-65/' || num || tail, bb || '/site/tv/' || num || '.p' || tail, wm || '/ip/Some-TV/' || num || tail,
     wm || '/reviews/product/' || num || tail, 'https://www.target.com/p/tv/-/A-' || num || tail,
     'https://shop.example.com/product/' || source || '/sku/' || num || '/reviews' || tail, wm || '/browse/tv' || tail][d % 11 + 1] AS source_url,
    CASE WHEN d % 4 = 0 THEN '4.3' WHEN d % 23 = 0 THEN 'n/a' END AS overall_rating,
    CASE WHEN NOT badge THEN {lst(f.RATINGS)}[d % 9 + 1] END AS rating,
    CASE WHEN badge THEN NULL ELSE CASE d % 13 WHEN 0 THEN NULL WHEN 1 THEN '1.0 out of 5 stars' WHEN 2 THEN 'My 55 inch set' ELSE split_part(text, chr(10), 1) END END AS title,
    CASE WHEN badge THEN 'Verified Purchase' ELSE CASE d % 17 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE text || {lst(suffixes)}[d % 12 + 1] END END AS review_text,
    CASE WHEN badge THEN NULL ELSE CASE d % 5 WHEN 0 THEN 'Reviewed in the United States on ' || strftime(dd, '%B %-d, %Y')
               WHEN 1 THEN CAST(dd AS VARCHAR) WHEN 2 THEN strftime(dd, '%-m/%-d/%Y')
               WHEN 4 THEN 'yesterday' END END AS review_date,
    CASE WHEN NOT badge AND d % 29 <> 0 THEN 'user' || CAST(d % 50 AS VARCHAR) END AS author,
    CASE WHEN d % 2 = 0 THEN 'Verified Purchase' END AS verified,
    '2026-01-01T00:00:00' AS scraped_at
  FROM (SELECT doc_id AS d, text, source, CAST(DATE '2025-01-01' + CAST(doc_id % 400 AS INTEGER) AS DATE) AS dd, doc_id % 31 = 7 AS badge,
          CAST(doc_id + 1000000 AS VARCHAR) AS num, '?ratings=' || CAST(doc_id % 5 + 1 AS VARCHAR) AS tail, 'B0' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS asin,
          'https://www.amazon.com' AS am, 'https://www.bestbuy.com' AS bb, 'https://www.walmart.com' AS wm FROM documents)
),
reviews_all AS (
  SELECT * FROM reviews_base
  UNION ALL
  SELECT review_ord + 1, model_id, model_name, size, site, source_url, overall_rating, rating,
         replace(title, ' ', '  '), replace(review_text, 'The', 'THE') || '  ', review_date, author, verified,
         '2026-01-02T00:00:00'
  FROM reviews_base WHERE review_ord % 20 = 0
),
reviews AS (
  SELECT review_ord, model_id, model_name, size, {channel_expr()} AS channel, site, source_url, overall_rating,
         rating, title, review_text, review_date, author, verified, scraped_at
  FROM reviews_all
)"""


DEDUPE_KEYS = ["model_id", "channel", "site", "title", "review_text", "review_date", "author"]


def deduped_cte(src: str = "reviews", name: str = "deduped") -> str:
    keys = ", ".join(nk(k) for k in DEDUPE_KEYS)
    return f"""
{name} AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY review_ord) AS _rn FROM {src}
  ) WHERE _rn = 1
)"""


def analysis_ctes() -> str:
    return reviews_cte() + "," + deduped_cte() + f""",
rated AS (SELECT *, {rating_num('rating')} AS rating_num FROM deduped WHERE {rating_num('rating')} IS NOT NULL),
low AS (SELECT *, {summary()} AS issue_summary FROM rated WHERE rating_num <= 3)"""


def taxonomy_cte(rules=fixtures.FIXTURE_TAXONOMY) -> str:
    rows = ", ".join(f"({q(c)}, {co}, {q(p)}, {po})" for c, co, p, po in fixtures.taxonomy_rows(rules))
    stop = lst(STOPWORDS)
    return f"""
tax AS (SELECT * FROM (VALUES {rows}) t(category, cat_ord, phrase, phrase_ord)),
tspec AS (
  SELECT category, cat_ord, phrase_ord, {strip('phrase')} AS phrase, np,
         len(string_split(np, ' ')) AS wc,
         list_filter(string_split(np, ' '), lambda t: length(t) >= 3 AND NOT list_contains({stop}, t)) AS tokens
  FROM (SELECT *, {match_norm('phrase')} AS np FROM tax) WHERE np <> ''
),
kw AS (
  SELECT category, string_agg(phrase, ', ' ORDER BY phrase_ord) AS keywords FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.category ORDER BY t.phrase_ord) AS rn
    FROM tax t WHERE t.cat_ord = (SELECT min(cat_ord) FROM tax t2 WHERE t2.category = t.category)
  ) WHERE rn <= 8 GROUP BY category
)"""


def scored_cte(src: str = "low", name: str = "scored") -> str:
    return f"""
{name}_pairs AS (
  SELECT l.review_ord, s.category, s.phrase, s.phrase_ord,
         CASE WHEN contains(l.mt, s.np) THEN 8 + s.wc
              WHEN len(list_filter(s.tokens, lambda x: contains(l.mt, x))) >= greatest(1, least(2, len(s.tokens)))
                THEN len(list_filter(s.tokens, lambda x: contains(l.mt, x)))
              ELSE 0 END AS score
  FROM (SELECT review_ord, {match_norm("coalesce(title, '') || ' ' || coalesce(review_text, '')")} AS mt FROM {src}) l
  CROSS JOIN tspec s
),
{name} AS (
  SELECT review_ord, category, phrase, score FROM (
    SELECT *, row_number() OVER (PARTITION BY review_ord ORDER BY score DESC, category, phrase_ord) AS rn
    FROM {name}_pairs WHERE score > 0
  ) WHERE rn = 1
)"""


def classified_cte(rules=fixtures.FIXTURE_TAXONOMY) -> str:
    return taxonomy_cte(rules) + "," + scored_cte() + """,
classified AS (
  SELECT l.*, coalesce(s.category, 'Other') AS "primary", coalesce(s.phrase, 'Other') AS secondary,
         coalesce(s.score, 0) AS score
  FROM low l LEFT JOIN scored s USING (review_ord)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _labeled_ctes() -> str:
    return analysis_ctes() + f""",
labeled AS (
  SELECT l.* REPLACE ({size_expr()} AS size, coalesce(strftime({parse_date(strip('CAST(l.review_date AS VARCHAR)'))}, '%Y-%m-%d'), l.review_date, '') AS review_date),
         coalesce(NULLIF({strip("coalesce(CAST(b.quality AS VARCHAR), '')")}, ''), 'Other') AS primary_label,
         coalesce(NULLIF({strip("coalesce(CAST(b.toxic AS VARCHAR), '')")}, ''), 'Other') AS secondary_label
  FROM low l JOIN labels b ON 2 * b.doc_id = l.review_ord
)"""


def _first_non_empty(col: str) -> str:
    t = strip(f"CAST({col} AS VARCHAR)")
    return f"arg_min({t}, review_ord) FILTER (WHERE {t} <> '')"


def S_key() -> str:
    """F7 of a row of the review table."""
    parts = [f"coalesce({c}, '')" for c in ("model_id", "site", "source_url", "rating", "review_date", "author")]
    parts += [collapse(f"coalesce({c}, '')") for c in ("title", "review_text")]
    return "sha256(" + " || '|' || ".join(parts) + ")"


def statements() -> dict:
    S = statements_core()
    S.update(grid_statements())
    S.update(record_statements())
    S.update(extract_statements())
    S.update(source_statements())
    S.update(sql_function_statements())
    S.update(message_statements())
    S.update(labeled_detail_statements())
    S.update(scorer_statements())
    S.update(report_grid_statements())
    return S


def statements_core() -> dict:
    S = {}
    S["read_reviews"] = with_(reviews_cte()) + " SELECT * FROM reviews"
    S["record_to_row"] = with_(reviews_cte()) + " SELECT review_ord, " + ", ".join(
        f"coalesce({c}, '') AS {c}" for c in ["model_id", "model_name", "size", "channel", "site", "source_url",
                                              "overall_rating", "rating", "title", "review_text", "review_date",
                                              "author", "verified", "scraped_at"]) + " FROM reviews"
    S["channel"] = with_(reviews_cte()) + " SELECT site, channel, count(*)::BIGINT AS n_rows FROM reviews GROUP BY site, channel"
    r05 = f"(CASE WHEN {rating_num('rating')} BETWEEN 0 AND 5 THEN {rating_num('rating')} END)"
    label = (f"(CASE WHEN {r05} IS NULL THEN '无评分' WHEN {r05} = floor({r05}) THEN CAST(CAST({r05} AS BIGINT) AS VARCHAR) || ' star' "
             f"ELSE CAST({r05} AS VARCHAR) || ' star' END)")
    S["parse_rating"] = with_(reviews_cte()) + (f" SELECT review_ord, {rating_num('rating')} AS rating_num, {r05} AS rating_0_5, "
                                                f"{label} AS rating_label, {rating_num('overall_rating')} AS overall_num FROM reviews")
    S["low_rating"] = with_(analysis_ctes()) + " SELECT review_ord, model_id, rating_num FROM low"
    S["norm_key"] = with_(reviews_cte()) + " SELECT review_ord, " + ", ".join(
        f"{nk(c)} AS k_{c}" for c in ("site", "title", "review_text", "review_date", "author")) + " FROM reviews"
    mt = match_norm("coalesce(title, '') || ' ' || coalesce(review_text, '')")
    S["norm_match_text"] = with_(reviews_cte()) + (
        f" SELECT review_ord, mt AS match_text, array_to_string(list_filter(string_split(mt, ' '), "
        f"lambda t: length(t) >= 3 AND NOT list_contains({lst(STOPWORDS)}, t)), ' ') AS tokens "
        f"FROM (SELECT review_ord, {mt} AS mt FROM reviews)")
    S["issue_summary"] = with_(reviews_cte()) + f" SELECT review_ord, {excerpt('review_text', 160)} AS excerpt_160, {summary()} AS issue_summary FROM reviews"
    S["text_hash"] = with_(reviews_cte()) + f" SELECT review_ord, sha256({collapse('coalesce(review_text, ' + q('') + ')')}) AS text_hash, {S_key()} AS review_key FROM reviews"
    S["review_dates"] = with_(reviews_cte()) + (
        f" SELECT review_ord, coalesce(strftime({review_date_ts()}, '%Y-%m-%d'), '') AS review_day, {clean_date()} AS clean_date, "
        f"strftime({dash_date()}, '%Y-%m-%d') AS dash_day, {week_label(dash_date())} AS week, "
        f"coalesce(strftime({parse_date(strip('CAST(review_date AS VARCHAR)'))}, '%Y-%m-%d'), review_date, '') AS date_or_raw FROM reviews")
    S["extract_size"] = with_(analysis_ctes()) + f" SELECT review_ord, {size_expr()} AS size_display FROM low"
    sn = strip("translate(model_id, '[]:*?/\\', '_______')")
    S["safe_name"] = with_(reviews_cte()) + (f" SELECT model_id, substr(CASE WHEN {sn} = '' THEN 'sheet' ELSE {sn} END, 1, 31) AS part_name, "
                                             f"count(*)::BIGINT AS n_rows FROM reviews GROUP BY model_id")
    S["dedupe_reviews"] = with_(reviews_cte(), deduped_cte()) + " SELECT * FROM deduped"
    S["dedupe_stats"] = with_(reviews_cte(), deduped_cte()) + (
        " SELECT (SELECT count(*) FROM reviews)::BIGINT AS original_count, (SELECT count(*) FROM deduped)::BIGINT AS deduped_count,"
        " ((SELECT count(*) FROM reviews) - (SELECT count(*) FROM deduped))::BIGINT AS removed_count")
    S["classify_keyword"] = with_(analysis_ctes(), classified_cte()) + ' SELECT review_ord, model_id, "primary", secondary, score FROM classified'
    S["phrase_match"] = with_(analysis_ctes(), taxonomy_cte(), scored_cte()) + " SELECT review_ord, category, phrase, score FROM scored_pairs WHERE score > 0"
    counts = """counts AS (SELECT model_id, "primary", count(*) AS n, min(review_ord) AS first_ord FROM classified
                WHERE model_id IS NOT NULL GROUP BY model_id, "primary")"""
    S["issue_counts"] = with_(analysis_ctes(), classified_cte(), counts) + """
      SELECT c.model_id, c."primary", c.n::BIGINT AS n_issues,
             round(c.n / sum(c.n) OVER (PARTITION BY c.model_id), 6) AS share,
             coalesce(k.keywords, '') AS keywords,
             row_number() OVER (PARTITION BY c.model_id ORDER BY c.n DESC, c.first_ord)::BIGINT AS issue_rank
      FROM counts c LEFT JOIN kw k ON k.category = c."primary" """
    S["top_issues_k"] = with_(analysis_ctes(), classified_cte()) + """
      SELECT "primary", count(*)::BIGINT AS n_issues FROM classified GROUP BY "primary"
      ORDER BY count(*) DESC, min(review_ord) LIMIT 3"""
    S["model_header"] = with_(analysis_ctes()) + """
      SELECT model_id, count(*)::BIGINT AS total_reviews, count(*) FILTER (WHERE rating_num <= 3)::BIGINT AS low_reviews
      FROM rated WHERE model_id IS NOT NULL GROUP BY model_id"""
    size_all = size_expr(("title", "review_text"))
    S["channel_metrics"] = with_(analysis_ctes()) + f""",
      m AS (SELECT *, upper(coalesce(channel, '')) AS ch,
                   CASE WHEN upper(coalesce(channel, '')) = 'AMZ' THEN '全部' ELSE {size_all} END AS sz,
                   {rating_num('overall_rating')} AS overall_num
            FROM rated WHERE model_id IS NOT NULL AND upper(coalesce(channel, '')) IN ('AMZ', 'BBY'))
      SELECT model_id, ch AS channel, sz AS size,
             coalesce({_first_non_empty('model_name')}, {_first_non_empty('model_id')}, '') AS model_name,
             round_even(coalesce(arg_min(overall_num, review_ord) FILTER (WHERE overall_num IS NOT NULL), avg(rating_num)), 1) AS avg_rating,
             count(*)::BIGINT AS n_reviews
      FROM m GROUP BY model_id, ch, sz"""
    S["overview"] = with_(_labeled_ctes()) + f""",
      g AS (SELECT model_id, size, coalesce({_first_non_empty('model_name')}, '') AS model_name, count(*) AS total
            FROM labeled WHERE model_id IS NOT NULL GROUP BY model_id, size)
      SELECT l.model_id, g.model_name, l.size, l.primary_label AS "primary", count(*)::BIGINT AS n_issues,
             round(count(*) / any_value(g.total), 6) AS share, any_value(g.total)::BIGINT AS total
      FROM labeled l JOIN g ON g.model_id = l.model_id AND g.size = l.size
      GROUP BY l.model_id, g.model_name, l.size, l.primary_label"""
    S["primary_summary"] = with_(_labeled_ctes()) + """
      SELECT model_id, size, primary_label AS "primary", count(*)::BIGINT AS n_issues,
             round(count(*) / any_value(t.total), 6) AS share, any_value(t.total)::BIGINT AS total
      FROM labeled JOIN (SELECT model_id, count(*) AS total FROM labeled GROUP BY model_id) t USING (model_id)
      WHERE model_id IS NOT NULL GROUP BY model_id, size, primary_label"""
    S["secondary_summary"] = with_(_labeled_ctes()) + """
      SELECT model_id, size, primary_label AS "primary", secondary_label AS secondary, count(*)::BIGINT AS n_issues,
             round(count(*) / any_value(t.total), 6) AS share
      FROM labeled JOIN (SELECT model_id, count(*) AS total FROM labeled GROUP BY model_id) t USING (model_id)
      WHERE model_id IS NOT NULL GROUP BY model_id, size, primary_label, secondary_label"""
    S["detail_seq"] = with_(analysis_ctes()) + f"""
      SELECT model_id, review_ord,
             row_number() OVER (PARTITION BY model_id ORDER BY {review_date_ts()} DESC NULLS LAST, review_ord)::BIGINT AS seq
      FROM low"""
    S["review_ids"] = with_(analysis_ctes()) + f""",
      t AS (SELECT *, {size_expr()} AS sz FROM low)
      SELECT review_ord, model_id, sz AS size,
             'R' || lpad(CAST(row_number() OVER (ORDER BY model_id, sz, {review_date_ts()} DESC NULLS LAST, review_ord) AS VARCHAR), 4, '0') AS review_id
      FROM t"""
    S.update(dashboard_statements())
    S.update(merge_statements())
    S.update(label_statements())
    S.update(page_statements())
    S.update(target_statements())
    S.update(stream_statements())
    return S


def _dash_cte() -> str:
    r05 = f"(CASE WHEN {rating_num('rating')} BETWEEN 0 AND 5 THEN {rating_num('rating')} END)"
    return f""",
dash AS (
  SELECT review_ord, coalesce(model_id, '') AS model_id, coalesce(channel, '') AS channel, coalesce(site, '') AS site,
         {r05} AS rating_num, {dash_date()} AS review_day, {week_label(dash_date())} AS week
  FROM deduped
),
filtered AS (
  SELECT * FROM dash
  WHERE model_id IN ('A7', 'B7', '32H1', 'D9 Pro') AND channel IN ('AMZ', 'BBY', 'WMT')
    AND rating_num IN (1.0, 2.5, 3.0, 4.0, 5.0)
    AND review_day >= DATE '2025-01-15' AND review_day < DATE '2025-12-31' + INTERVAL 1 DAY
)"""


def _counts_sql() -> str:
    return """,
counts AS (SELECT model_id, "primary", count(*) AS n, min(review_ord) AS first_ord FROM classified
           WHERE model_id IS NOT NULL GROUP BY model_id, "primary"),
summary AS (
  SELECT c.model_id, c."primary", c.n::BIGINT AS n_issues, round(c.n / sum(c.n) OVER (PARTITION BY c.model_id), 6) AS share,
         coalesce(k.keywords, '') AS keywords,
         row_number() OVER (PARTITION BY c.model_id ORDER BY c.n DESC, c.first_ord)::BIGINT AS issue_rank
  FROM counts c LEFT JOIN kw k ON k.category = c."primary"
)"""


def dashboard_statements() -> dict:
    S = {}
    base = with_(analysis_ctes()) + _dash_cte()
    full = with_(analysis_ctes(), classified_cte()) + _dash_cte() + _counts_sql()
    S["facet_filter"] = base + " SELECT review_ord, model_id, channel, rating_num, strftime(review_day, '%Y-%m-%d') AS review_day FROM filtered"
    S["semi_join_models"] = full + " SELECT * FROM summary WHERE model_id IN (SELECT model_id FROM filtered)"
    chans = ["AMZ", "BBY", "CSC", "TARGET", "WMT"]
    S["model_channel_pivot"] = base + " SELECT model_id, " + ", ".join(
        f"count(*) FILTER (WHERE channel = '{c}')::BIGINT AS \"{c}\"" for c in chans) + \
        ", count(*)::BIGINT AS total FROM dash GROUP BY model_id"
    S["model_channel_rollup"] = base + " SELECT model_id, channel, GROUPING(model_id, channel)::INTEGER AS margin, count(*)::BIGINT AS n_reviews FROM dash GROUP BY CUBE (model_id, channel)"
    S["weekly_authors"] = with_(analysis_ctes()) + f""" SELECT week, count(*)::BIGINT AS n_reviews, count(DISTINCT nullif(author, ''))::BIGINT AS n_authors
      FROM (SELECT author, {week_label(dash_date())} AS week FROM deduped) WHERE week <> '' GROUP BY week"""
    S["weekly_trend"] = base + " SELECT week, model_id, count(*)::BIGINT AS n_reviews FROM dash WHERE week <> '' GROUP BY week, model_id"
    S["weekly_trend_one"] = base + (" SELECT week, model_id, count(*)::BIGINT AS n_reviews FROM dash WHERE week <> '' "
                                    "AND model_id IN ('A7', 'C8') GROUP BY week, model_id")
    S["issue_share_dashboard"] = full + """,
      per AS (SELECT model_id, "primary", sum(coalesce(TRY_CAST(CAST(n_issues AS VARCHAR) AS DOUBLE), 0)) AS n FROM summary GROUP BY model_id, "primary")
      SELECT model_id, "primary", n AS n_issues,
             round(coalesce(n / NULLIF(sum(n) OVER (PARTITION BY model_id), 0), 0) * 100, 6) AS share_pct FROM per"""
    S["issue_top"] = full + ' SELECT "primary", sum(n_issues)::BIGINT AS n_issues FROM summary GROUP BY "primary"'
    S["kpis"] = full + """
      SELECT 'total' AS kpi, count(*)::BIGINT AS value FROM filtered
      UNION ALL SELECT 'low', count(*) FILTER (WHERE rating_num <= 3)::BIGINT FROM filtered
      UNION ALL SELECT 'models', count(DISTINCT model_id)::BIGINT FROM filtered
      UNION ALL SELECT 'channels', count(DISTINCT channel)::BIGINT FROM filtered
      UNION ALL SELECT 'classified', count(*)::BIGINT FROM classified WHERE model_id IN (SELECT model_id FROM filtered)"""
    S["facet_values"] = base + """
      SELECT DISTINCT 'model' AS facet, model_id AS value FROM dash
      UNION SELECT DISTINCT 'channel', channel FROM dash
      UNION SELECT DISTINCT 'rating', CAST(rating_num AS VARCHAR) FROM dash WHERE rating_num IS NOT NULL
      UNION ALL SELECT 'date_min', CAST(min(review_day) AS VARCHAR) FROM dash
      UNION ALL SELECT 'date_max', CAST(max(review_day) AS VARCHAR) FROM dash"""
    S["records_per_target"] = with_(reviews_cte()) + " SELECT model_id, site, count(*)::BIGINT AS n_records FROM reviews GROUP BY model_id, site"
    return S


def _split_ctes() -> str:
    return """,
existing AS (SELECT * FROM reviews WHERE scraped_at = '2026-01-01T00:00:00' AND review_ord % 3 <> 0),
incoming AS (SELECT * FROM reviews WHERE NOT (scraped_at = '2026-01-01T00:00:00' AND review_ord % 3 <> 0)),
both_src AS (SELECT *, 0 AS _src FROM existing UNION ALL SELECT *, 1 AS _src FROM incoming)"""


def _template_sql() -> str:
    return f""",
tpl0 AS (SELECT *, {size_expr()} AS sz, {review_date_ts()} AS sort_ts FROM low),
tpl AS (
  SELECT review_ord,
         'R' || lpad(CAST(row_number() OVER (ORDER BY model_id, sz, sort_ts DESC NULLS LAST, review_ord) AS VARCHAR), 4, '0') AS review_id,
         model_id, model_name, sz AS size, channel, site, coalesce(overall_rating, '') AS overall_rating, rating,
         coalesce(strftime(sort_ts, '%Y-%m-%d'), '') AS review_date, title, review_text, issue_summary,
         '' AS primary_label, '' AS secondary_label, '' AS reason_label
  FROM tpl0
)"""


def merge_statements() -> dict:
    S = {}
    keys = ", ".join(nk(k) for k in DEDUPE_KEYS)
    base = with_(reviews_cte()) + _split_ctes()
    S["union_reviews"] = base + """
      SELECT review_ord, model_id, NULL::VARCHAR AS overall_rating, NULL::VARCHAR AS verified FROM existing
      UNION ALL SELECT review_ord, model_id, overall_rating, verified FROM incoming"""
    S["new_reviews"] = base + "," + deduped_cte("incoming", "inc_first") + f"""
      SELECT * FROM inc_first i WHERE NOT EXISTS (
        SELECT 1 FROM existing e WHERE {' AND '.join(f"{nk('e.' + k)} = {nk('i.' + k)}" for k in DEDUPE_KEYS)})"""
    merged = base + f""",
      merged AS (SELECT * EXCLUDE (_rn, _src) FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY _src, review_ord) AS _rn FROM both_src) WHERE _rn = 1)"""
    S["merge_reviews"] = merged + " SELECT * FROM merged"
    S["merge_stats"] = merged + """
      SELECT (SELECT count(*) FROM existing)::BIGINT AS existing_count,
             ((SELECT count(*) FROM merged) - (SELECT count(*) FROM existing))::BIGINT AS added_count,
             (SELECT count(*) FROM merged)::BIGINT AS total_count"""
    S["write_reviews_by_model"] = with_(reviews_cte(), deduped_cte()) + f"""
      SELECT review_ord, model_id,
             row_number() OVER (PARTITION BY model_id ORDER BY {review_date_ts()} DESC NULLS LAST, review_ord)::BIGINT AS seq
      FROM deduped"""
    S["write_deduped"] = with_(reviews_cte(), deduped_cte()) + " SELECT * FROM deduped"
    S["export_filtered"] = with_(analysis_ctes()) + _dash_cte() + """
      SELECT CAST(review_ord AS VARCHAR) AS review_ord, model_id, channel, CAST(rating_num AS VARCHAR) AS rating_num,
             strftime(review_day, '%Y-%m-%d') AS review_day FROM filtered"""
    S["labeling_template"] = with_(analysis_ctes()) + _template_sql() + " SELECT * FROM tpl"
    S["read_classified"] = with_(analysis_ctes()) + _template_sql() + f"""
      SELECT t.review_ord, t.review_id, t.size,
             coalesce(strftime({parse_date(strip('t.review_date'))}, '%Y-%m-%d'), t.review_date, '') AS review_date,
             coalesce(NULLIF({strip("coalesce(CAST(b.quality AS VARCHAR), '')")}, ''), 'Other') AS primary_label,
             coalesce(NULLIF({strip("coalesce(CAST(b.toxic AS VARCHAR), ' ')")}, ''), 'Other') AS secondary_label
      FROM tpl t LEFT JOIN labels b ON 2 * b.doc_id = t.review_ord"""
    return S


def _items_cte() -> str:
    key = " || '|' || ".join([f"coalesce({c}, '')" for c in ("model_id", "site", "source_url", "rating", "review_date", "author")]
                             + [collapse(f"coalesce({c}, '')") for c in ("title", "review_text")])
    return f""",
items AS (
  SELECT *, row_number() OVER (ORDER BY review_ord) - 1 AS item_id,
         (row_number() OVER (ORDER BY review_ord) - 1) // 3 AS batch_id, sha256({key}) AS cache_key
  FROM low
)"""


def _responses_cte() -> str:
    from revlens.plans.labeling import ANSWERS, UNLABELLED
    p = "CASE " + " ".join(f"WHEN b.quality = {qq} AND b.toxic = {tt} THEN {q(pp)}" for (qq, tt), (pp, _) in ANSWERS.items()) + f" ELSE {q(UNLABELLED[0])} END"
    s = "CASE " + " ".join(f"WHEN b.quality = {qq} AND b.toxic = {tt} THEN {q(ss)}" for (qq, tt), (_, ss) in ANSWERS.items()) + f" ELSE {q(UNLABELLED[1])} END"
    return f""",
ans AS (SELECT i.batch_id, i.item_id, {p} AS p, {s} AS s FROM items i LEFT JOIN labels b ON 2 * b.doc_id = i.review_ord),
per_batch AS (
  SELECT batch_id, min(item_id) AS first_id,
         string_agg('{{"id":' || item_id || ',"primary":"' || p || '","secondary":"' || s || '","reason":"label ' || item_id || '"}}', ',' ORDER BY item_id) AS objs
  FROM ans GROUP BY batch_id
),
responses AS (
  SELECT batch_id,
    CASE WHEN batch_id % 7 = 6 THEN 'no answer today'
         WHEN batch_id % 5 = 0 THEN '[' || objs || ']'
         WHEN batch_id % 5 = 1 THEN '```json' || chr(10) || '[' || objs || ']' || chr(10) || '```'
         WHEN batch_id % 5 = 2 THEN '<think>checking</think>[' || objs || ']'
         WHEN batch_id % 5 = 3 THEN 'Here: [' || objs || ',]'
         ELSE '[' || objs || ',{{"id":' || first_id || ',"primary":"Other","secondary":"Please add comments","reason":"dup"}}]' END AS content
  FROM per_batch
)"""


def _parsed_cte() -> str:
    t0 = strip("content")
    fenced = strip(f"regexp_replace(regexp_replace({t0}, '(?i)^```(?:json)?{WS}*', ''), '{WS}*```$', '')")
    t1 = f"(CASE WHEN starts_with({t0}, '```') THEN {fenced} ELSE {t0} END)"
    t2 = strip(f"regexp_replace({t1}, '(?is)<think>.*?</think>', '', 'g')")
    schema = '[{"id":"BIGINT","primary":"VARCHAR","secondary":"VARCHAR","reason":"VARCHAR"}]'
    reason = "regexp_extract(regexp_replace(o, '\\}$', ''), '(?s)\"reason\"\\s*:\\s*\"(.*)\"\\s*$', 1)"
    unesc = strip(f"replace(replace(replace(replace({reason}, '\\\"', '\"'), '\\n', ' '), '\\r', ' '), '\\t', ' ')")
    rec_obj = (f"{{'id': TRY_CAST(NULLIF(regexp_extract(o, '\"id\"\\s*:\\s*(\\d+)', 1), '') AS BIGINT), "
               f"'primary': trim(regexp_extract(o, '\"primary\"\\s*:\\s*\"([^\"]*)\"', 1)), "
               f"'secondary': trim(regexp_extract(o, '\"secondary\"\\s*:\\s*\"([^\"]*)\"', 1)), "
               f"'reason': CASE WHEN {reason} <> '' THEN {unesc} ELSE '{'API 返回格式已修复'}' END, "
               f"'ok': regexp_matches(o, '\"id\"\\s*:\\s*\\d+') AND regexp_matches(o, '\"primary\"\\s*:\\s*\"') "
               f"AND regexp_matches(o, '\"secondary\"\\s*:\\s*\"')}}")
    return f""",
sliced AS (
  SELECT batch_id, t,
         CASE WHEN instr(t, '[') > 0 AND instr(reverse(t), ']') > 0
                   AND length(t) - instr(reverse(t), ']') + 1 > instr(t, '[')
              THEN substr(t, instr(t, '['), length(t) - instr(reverse(t), ']') + 1 - instr(t, '[') + 1) END AS arr
  FROM (SELECT batch_id, {t2} AS t FROM responses)
),
lists AS (
  SELECT batch_id,
         -- DuckDB accepts trailing commas; strict JSON (as in Python and Spark) does not
         CASE WHEN json_valid(arr) AND NOT regexp_matches(arr, ',\\s*[\\]}}]') THEN from_json(arr, '{schema}') END AS strict_list,
         list_transform(list_filter(list_transform(regexp_extract_all(coalesce(arr, ''), '(?s)(\\{{.*?\\}})', 1), lambda o: {rec_obj}),
                                    lambda x: x.ok),
                        lambda x: {{'id': x.id, 'primary': x."primary", 'secondary': x.secondary, 'reason': x.reason}}) AS rec_list
  FROM sliced
),
answers AS (
  SELECT batch_id, CASE WHEN strict_list IS NOT NULL THEN strict_list ELSE rec_list END AS a,
         CASE WHEN strict_list IS NOT NULL THEN 'json' WHEN len(rec_list) > 0 THEN 'recovered' ELSE 'unparsable' END AS status
  FROM lists
),
parsed AS (
  SELECT batch_id, status, CAST(i - 1 AS INTEGER) AS pos, a[i].id AS id, a[i]."primary" AS "primary",
         a[i].secondary AS secondary, a[i].reason AS reason
  FROM answers, range(1, len(a) + 1) r(i)
  UNION ALL
  SELECT batch_id, status, NULL, NULL, NULL, NULL, NULL FROM answers WHERE a IS NULL OR len(a) = 0
),
last_ans AS (
  SELECT batch_id, id, arg_max("primary", pos) AS "primary", arg_max(secondary, pos) AS secondary, arg_max(reason, pos) AS reason
  FROM parsed WHERE id IS NOT NULL GROUP BY batch_id, id
),
defaulted AS (
  SELECT i.review_ord, i.item_id, i.batch_id, i.cache_key,
         coalesce(l."primary", 'Other') AS "primary",
         CASE WHEN l."primary" IS NOT NULL THEN coalesce(l.secondary, '') ELSE 'Please add comments' END AS secondary,
         CASE WHEN l."primary" IS NOT NULL THEN coalesce(l.reason, '')
              WHEN i.batch_id IN (SELECT batch_id FROM parsed WHERE status = 'unparsable') THEN '{'API 返回格式异常，未能稳定解析分类结果'}'
              ELSE '{'API 未返回有效分类结果'}' END AS reason
  FROM items i LEFT JOIN last_ans l ON l.batch_id = i.batch_id AND l.id = i.item_id
),
validated AS (
  SELECT review_ord, item_id, batch_id, cache_key,
         CASE WHEN ok THEN p ELSE 'Other' END AS "primary",
         CASE WHEN ok THEN s ELSE 'Please add comments' END AS secondary,
         CASE WHEN NOT bad_p AND NOT bad_s THEN r WHEN r <> '' THEN r
              WHEN bad_p THEN '{'返回的一级分类不在分类表中'}' ELSE '{'返回的二级分类不在分类表中'}' END AS reason
  FROM (
    SELECT *, NOT (p IN (SELECT category FROM tax)) AS bad_p,
           NOT EXISTS (SELECT 1 FROM tax WHERE tax.category = p AND {strip('tax.phrase')} = s) AS bad_s,
           (p IN (SELECT category FROM tax)) AND EXISTS (SELECT 1 FROM tax WHERE tax.category = p AND {strip('tax.phrase')} = s) AS ok
    FROM (SELECT *, trim(coalesce("primary", '')) AS p, trim(coalesce(secondary, '')) AS s, trim(coalesce(reason, '')) AS r FROM defaulted)
  )
)"""


def label_statements() -> dict:
    S = {}
    base = with_(analysis_ctes(), taxonomy_cte()) + _items_cte()
    S["batch_ids"] = base + " SELECT review_ord, item_id, batch_id FROM items"
    tax_map = "MAP {" + ", ".join(f"{q(c)}: {lst(ps)}" for c, ps in fixtures.FIXTURE_TAXONOMY) + "}"
    item = ("{'id': item_id, 'cache_id': cache_key, 'model': coalesce(model_name, ''), 'channel': coalesce(channel, ''), "
            "'rating': coalesce(rating, ''), 'date': coalesce(review_date, ''), "
            f"'title': {excerpt('title', 160)}, 'review': {excerpt('review_text', 900)}, 'summary': {excerpt('issue_summary', 260)}}}")
    S["classify_requests"] = base + f"""
      SELECT batch_id, count(*)::BIGINT AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids,
             to_json({{'taxonomy': {tax_map}, 'reviews': list({item} ORDER BY item_id)}}) AS payload
      FROM items GROUP BY batch_id"""
    full = base + _responses_cte() + _parsed_cte()
    S["parse_label_responses"] = full + " SELECT batch_id, status, pos, id, \"primary\", secondary, reason FROM parsed"
    S["results_with_default"] = full + ' SELECT review_ord, "primary", secondary, reason FROM defaulted'
    S["validate_labels"] = full + ' SELECT review_ord, "primary", secondary, reason FROM validated'
    S["cache_hit_miss"] = full + """,
      cache AS (SELECT cache_key, "primary" FROM validated WHERE review_ord IN (SELECT 2 * doc_id FROM labels WHERE quality = 1))
      SELECT i.review_ord, 1 AS hit, c."primary" FROM items i JOIN cache c USING (cache_key)
      UNION ALL SELECT i.review_ord, 0, NULL FROM items i WHERE i.cache_key NOT IN (SELECT cache_key FROM cache)"""
    return S


# The entities that occur in the driver's pages, '&amp;' last.
PAGE_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _blocks_cte() -> str:
    clean = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
    t = "regexp_replace(regexp_replace(x, '(?is)</(?:p|article|body|div|section|main)>.*$', ''), '<[^>]*>', ' ', 'g')"
    for ent, ch in PAGE_ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = collapse(t)
    return f""",
pieces AS (SELECT page_id, url, string_split_regex({clean}, '(?i)<p\\b[^>]*>') AS parts FROM pages),
blocks AS (
  SELECT page_id, CAST(i - 2 AS INTEGER) AS block_no, (list_transform(parts, lambda x: {t}))[i] AS text
  FROM pieces, range(2, len(parts) + 1) r(i)
),
blocks_ne AS (SELECT * FROM blocks WHERE text <> '')"""


def page_statements() -> dict:
    S = {}
    base = "WITH _x AS (SELECT 1)" + _blocks_cte()
    S["page_blocks"] = base + " SELECT page_id, block_no, text FROM blocks_ne"
    shop = "['amazon', 'bestbuy', 'walmart', 'target'][(review_ord // 2) % 4 + 1]"
    S["page_status"] = with_(reviews_cte()) + f""" SELECT review_ord AS page_id, CASE
        WHEN {shop} = 'amazon' THEN CASE WHEN n < 4 OR n = 12 THEN 'auth' WHEN n < 8 THEN 'captcha' WHEN n < 12 THEN 'robot' WHEN n < 16 THEN 'page' ELSE 'reviews' END
        WHEN {shop} = 'walmart' THEN CASE WHEN n < 4 THEN 'page' WHEN n < 8 THEN 'reviews' WHEN n < 12 THEN 'robot' ELSE 'page' END
        ELSE 'page' END AS status
      FROM (SELECT *, review_ord % 22 AS n FROM reviews) UNION ALL SELECT -1 - page_id, 'page' FROM pages"""
    S["url_query_param"] = """SELECT page_id, NULLIF(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1), '') AS host,
        NULLIF(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
        NULLIF(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages"""
    nat = ("array_to_string(list_transform(regexp_extract_all(url, '(\\d+|\\D+)', 1), "
           "lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN lpad(ltrim(x, '0'), 60, '0') ELSE lower(x) END), '')")
    S["natural_sort"] = f"SELECT page_id, row_number() OVER (ORDER BY {nat}, page_id)::BIGINT AS nat_rank FROM pages"
    per_page = base + """,
      tp AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS target FROM pages),
      firsts AS (
        SELECT target, arg_min(page_id, (page_id, block_no)) AS page_id FROM blocks_ne JOIN tp USING (page_id)
        GROUP BY target, lower(text)),
      per_page AS (
        SELECT tp.target, tp.page_id, coalesce(c.n, 0)::BIGINT AS n_new FROM tp
        LEFT JOIN (SELECT target, page_id, count(*) AS n FROM firsts GROUP BY target, page_id) c
          ON c.target = tp.target AND c.page_id = tp.page_id)"""
    S["dedupe_page_records"] = per_page + " SELECT * FROM per_page"
    cutoff = lambda k: per_page + f""",
      isl AS (SELECT *, sum(CASE WHEN n_new = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY target ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS island FROM per_page),
      stk AS (SELECT *, CASE WHEN n_new = 0 THEN row_number() OVER (PARTITION BY target, island ORDER BY page_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS streak FROM isl),
      st AS (SELECT *, min(CASE WHEN streak >= {k} THEN page_id END) OVER (PARTITION BY target) AS stop_at FROM stk)
      SELECT target, page_id, n_new, stop_at, (stop_at IS NULL OR page_id <= stop_at) AS kept FROM st"""  # noqa: E731
    S["crawl_cutoff"] = cutoff(1)
    S["crawl_cutoff_by_source"] = cutoff("[5, 3, 1][length(target) % 3 + 1]")
    S["captured_pages"] = """SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS host,
        sha256(page_id || ' ' || coalesce(html, '') || chr(10)) AS html_sha256 FROM pages"""
    return S


def sql_set_params(url: str, updates: dict, defaults: dict | None = None) -> str:
    """DuckDB form of F27 (keep other parameters in order, update in place, append new)."""
    base = f"regexp_extract({url}, '^([^?#]*)', 1)"
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_filter(string_split({query}, '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '='))"
    keys = f"list_transform({pairs}, lambda p: split_part(p, '=', 1))"
    case = "CASE " + " ".join(f"WHEN split_part(p, '=', 1) = {q(k)} THEN {q(k)} || '=' || url_encode({v})"
                              for k, v in updates.items()) + " ELSE p END" if updates else "p"
    kept = f"list_transform({pairs}, lambda p: {case})"
    extra = [f"CASE WHEN NOT list_contains({keys}, {q(k)}) THEN {q(k)} || '=' || url_encode({v}) END" for k, v in updates.items()]
    extra += [f"CASE WHEN NOT list_contains({keys}, {q(k)}) THEN {q(k + '=' + v)} END" for k, v in (defaults or {}).items()]
    allp = f"list_concat({kept}, list_filter([{', '.join(extra)}], lambda x: x IS NOT NULL))" if extra else kept
    return f"({base} || '?' || array_to_string({allp}, '&'))"


def _targets_cte() -> str:
    from revlens.functions.sites import STAR_NAMES
    from revlens.operators.targets import PREFIXES, REGISTRY
    key = strip("lower(site)")
    prof = ("CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in REGISTRY.items()) + " "
            + " ".join(f"WHEN {' OR '.join(f'starts_with({key}, {q(p)})' for p in ps)} THEN {q(kind)}" for kind, ps in PREFIXES)
            + f" ELSE 'generic:' || {key} END")
    star_digit = "regexp_extract(lower(site), '(?:amazon|amz)_(\\d)(?:\\D|$)', 1)"
    star = "CASE " + " ".join(f"WHEN {star_digit} = {q(k)} THEN {q(v)}" for k, v in STAR_NAMES.items()) + " END"
    # ids by the shape of the fixture's addresses, not by the engine's patterns
    after = "split_part(split_part(url, '?', 1), "
    pid = (f"CASE WHEN contains(url, '/product-reviews/') THEN split_part({after}'/product-reviews/', 2), '/', 1) "
           f"WHEN contains(url, 'amazon') AND contains(url, '/dp/') THEN upper({after}'/dp/', 2)) "
           f"WHEN contains(url, 'bestbuy') AND contains(url, '/sku/') THEN split_part({after}'/sku/', 2), '/', 1) "
           f"WHEN contains(url, '/site/reviews/') THEN split_part(url, '?', 1)[-7:] "
           f"WHEN contains(url, '/ip/') OR contains(url, 'walmart.com/reviews/product/') THEN split_part(url, '?', 1)[-7:] END")
    return f""",
per_site AS (SELECT model_id, site, arg_min(source_url, review_ord) AS url, arg_min(channel, review_ord) AS ch,
                    count(*) AS n FROM reviews GROUP BY model_id, site),
names AS (SELECT model_id, coalesce({_first_non_empty('model_name')}, model_id) AS display_name FROM reviews GROUP BY model_id),
all_targets AS (
  SELECT p.model_id, nm.display_name, p.site, ch IN ('AMZ', 'BBY', 'WMT') AS enabled, url,
         CAST(ceil(n / 10) AS INTEGER) AS max_pages, {star} AS star_filter, {pid} AS product_id, {prof} AS profile
  FROM per_site p JOIN names nm USING (model_id)
),
targets AS (SELECT * FROM all_targets WHERE enabled AND {strip("coalesce(url, '')")} <> '')"""


def target_statements() -> dict:
    S = {}
    base = with_(reviews_cte()) + _targets_cte()
    S["scrape_targets"] = base + " SELECT model_id, display_name, site, url, max_pages, star_filter, product_id, profile FROM targets"
    S["filter_targets"] = base + """ SELECT model_id, site, url FROM targets
      WHERE (model_id = 'B7 Series' OR display_name = 'B7 Series')
        AND (lower(site) = 'amazon' OR starts_with(lower(site), 'amazon') OR starts_with(lower(site), 'amz_'))"""
    u = strip("coalesce(url, '')")
    S["target_status"] = base + f""" SELECT model_id, site, CASE WHEN enabled AND {u} <> '' THEN '✓' ELSE '○' END AS status,
      CASE WHEN {u} <> '' THEN {u} ELSE '（未填写 URL）' END AS url_preview FROM all_targets"""
    n = "CAST(page_no AS VARCHAR)"
    amazon = sql_set_params("url", {"pageNumber": n}, {"reviewerType": "all_reviews"})
    amazon = f"(CASE WHEN star_filter IS NOT NULL THEN {sql_set_params(amazon, {'filterByStar': 'star_filter'})} ELSE {sql_set_params(amazon, {}, {'filterByStar': 'all_stars'})} END)"
    amazon = sql_set_params(amazon, {}, {"ie": "UTF8"})
    paged = sql_set_params("url", {"page": n})
    S["page_plan"] = base + f""",
      plan AS (SELECT t.*, page_no FROM targets t,
               range(1, (CASE WHEN starts_with(profile, 'generic:') THEN 1 ELSE greatest(max_pages, 1) END) + 1) r(page_no))
      SELECT model_id, site, profile AS kind, CAST(page_no AS INTEGER) AS page_no,
             CASE WHEN profile = 'amazon' THEN {amazon}
                  WHEN profile = 'bestbuy' THEN CASE WHEN page_no <= 1 THEN url ELSE {paged} END
                  WHEN profile = 'walmart' AND product_id IS NOT NULL THEN 'https://www.walmart.com/reviews/product/' || product_id || '?page=' || {n} || '&sort=submission-desc'
                  WHEN profile = 'walmart' THEN {paged} ELSE url END AS page_url
      FROM plan"""
    key = "coalesce(product_id, model_id)"
    listed = f"CASE WHEN contains(url, '/product-reviews/') THEN url ELSE 'https://www.amazon.com/product-reviews/' || {key} || '?' || split_part(url, '?', 2) END"
    all_stars = sql_set_params(f"({listed})", {"pageNumber": "'1'", "filterByStar": "'all_stars'", "reviewerType": "'all_reviews'"}, {"ie": "UTF8"})
    rating = "substr(split_part(url, '?ratings=', 2), 1, 1)"
    S["url_candidates"] = base + f"""
      SELECT model_id, site, CASE profile
        WHEN 'amazon' THEN 'https://www.amazon.com/dp/' || {key} || ' ' || {all_stars} || ' ' || url
        WHEN 'bestbuy' THEN CASE WHEN contains(url, '/AB1/sku/') THEN 'https://www.bestbuy.com/product/tv-55/AB1/sku/' || product_id || ' https://www.bestbuy.com/site/reviews/tv-55/' || product_id || '?ratings=' || {rating} || ' ' || url
                                 WHEN contains(url, '/site/reviews/') THEN 'https://www.bestbuy.com/site/tv-65/' || product_id || '.p ' || url ELSE url END
        WHEN 'walmart' THEN CASE WHEN product_id IS NULL THEN url ELSE 'https://www.walmart.com/ip/' || product_id || ' https://www.walmart.com/reviews/product/' || product_id || ' ' || url END
        ELSE url END AS candidates FROM targets"""
    return S


def stream_statements() -> dict:
    S = {}
    S["stream_merge"] = merge_statements()["merge_reviews"]
    S["stream_dedupe"] = """SELECT event_id, user_id, event_type FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL)
      WHERE before IS NULL OR ts - before > INTERVAL 1 HOUR"""
    S["stream_first_seen"] = "SELECT DISTINCT user_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL"
    S["stream_weekly"] = "SELECT strftime(ts, '%G-W%V') AS week, event_type, count(*)::BIGINT AS n_events FROM events GROUP BY 1, 2"
    return S


def grid_statements() -> dict:
    from revlens.sources.taxonomy import FALLBACK_RULES
    S = {}
    S["grid_tables"] = with_(analysis_ctes(), classified_cte()) + """,
      counts AS (SELECT model_id, "primary", count(*) AS n FROM classified WHERE model_id IS NOT NULL GROUP BY model_id, "primary")
      SELECT c.model_id, c."primary", c.n::BIGINT AS n_issues, round(c.n / sum(c.n) OVER (PARTITION BY c.model_id), 6) AS share,
             coalesce(k.keywords, '') AS keywords
      FROM counts c LEFT JOIN kw k ON k.category = c."primary" """
    S["classify_fallback"] = with_(analysis_ctes(), classified_cte(FALLBACK_RULES)) + """,
      counts AS (SELECT model_id, "primary", count(*) AS n, min(review_ord) AS first_ord FROM classified
                 WHERE model_id IS NOT NULL GROUP BY model_id, "primary")
      SELECT c.model_id, c."primary", c.n::BIGINT AS n_issues,
             round(c.n / sum(c.n) OVER (PARTITION BY c.model_id), 6) AS share,
             coalesce(k.keywords, '') AS keywords,
             row_number() OVER (PARTITION BY c.model_id ORDER BY c.n DESC, c.first_ord)::BIGINT AS issue_rank
      FROM counts c LEFT JOIN kw k ON k.category = c."primary" """
    return S


def record_statements() -> dict:
    from revlens.operators.records import BADGE_TEXTS
    S = {}
    base = with_(reviews_cte())
    blank = lambda c: "(" + strip("coalesce(" + c + ", '')") + " = '')"
    S["has_content"] = base + f" SELECT review_ord FROM reviews WHERE NOT ({blank('review_text')} AND {blank('title')})"
    text = "lower(" + strip("coalesce(NULLIF(review_text, ''), NULLIF(title, ''), '')") + ")"
    S["drop_badge_only"] = base + (f" SELECT review_ord FROM reviews WHERE NOT ({text} IN ({', '.join(q(b) for b in BADGE_TEXTS)}) "
                                   f"AND rating IS NULL AND {blank('author')} AND {blank('review_date')})")
    wanted = "NULLIF(regexp_extract(source_url, '[?&]ratings=([^&#]*)', 1), '')"
    got = f"NULLIF(coalesce(NULLIF(regexp_extract(rating, '\\d+(?:\\.\\d+)?', 0), ''), trim(rating)), '')"
    S["rating_filter_match"] = base + f" SELECT review_ord, rating FROM reviews WHERE {wanted} IS NULL OR {got} IS NULL OR {got} = {wanted}"
    S["ordered_distinct"] = base + """
      SELECT model_id, string_agg(site, ',' ORDER BY first_ord) AS sites FROM (
        SELECT model_id, site, min(review_ord) AS first_ord FROM reviews WHERE site IS NOT NULL GROUP BY model_id, site)
      GROUP BY model_id"""
    return S


def extract_statements() -> dict:
    """Answers from the rows the shop pages were made from: every text of a page is the
    source text with white space collapsed; nothing is matched in markup."""
    S = {}
    base = with_(reviews_cte())
    clean = lambda c: f"NULLIF({collapse(c)}, '')"
    number = lambda c: f"coalesce(NULLIF(regexp_extract({c}, '\\d+(?:\\.\\d+)?', 0), ''), {clean(c)})"
    for i, shop in enumerate(["amazon", "bestbuy", "walmart", "target"]):
        rating = number("rating || ' stars'") if shop == "walmart" else number("rating")
        # a walmart date is an attribute; the others are element texts
        author = clean("'by ' || author") if shop == "bestbuy" else clean("author")
        S[f"extract_reviews_{shop}"] = base + f""" SELECT * FROM (
          SELECT review_ord AS page_id, 0::INTEGER AS block_no, {"'R' || CAST(review_ord AS VARCHAR)" if shop == "amazon" else "NULL::VARCHAR"} AS block_id,
                 {rating} AS rating, {clean('title')} AS title, {clean('review_text')} AS review_text, {clean('review_date')} AS review_date, {author} AS author,
                 {clean('verified') if shop == 'amazon' else 'NULL::VARCHAR'} AS verified,
                 {"CASE review_ord % 3 WHEN 0 THEN '55寸' WHEN 1 THEN '43寸' END" if shop == 'amazon' else 'NULL::VARCHAR'} AS size
          FROM reviews WHERE (review_ord // 2) % 4 = {i}) WHERE review_text IS NOT NULL OR title IS NOT NULL"""
    S["extract_reviews_generic"] = base + f""" SELECT * FROM (
          SELECT review_ord AS page_id, 0::INTEGER AS block_no, NULL::VARCHAR AS block_id, {number('rating')} AS rating, {clean('title')} AS title, {clean('review_text')} AS review_text,
                 {clean('review_date')} AS review_date, {clean('author')} AS author, NULL::VARCHAR AS verified, NULL::VARCHAR AS size FROM reviews)
          WHERE review_text IS NOT NULL OR title IS NOT NULL"""
    n = "(review_ord // 2)"
    body = f"NULLIF(CASE WHEN {n} % 7 = 0 THEN CASE WHEN {clean('review_text')} IS NULL THEN 'more' ELSE {clean('review_text')} || ', more' END ELSE {clean('review_text')} END, '')"
    record = f"""SELECT review_ord AS page_id, model_id, {number('rating')} AS rating, {clean('title')} AS title, {body} AS review_text,
                        {clean('review_date')} AS review_date, {clean('author')} AS author FROM reviews"""
    badge = "lower(coalesce(review_text, title)) = 'verified purchase' AND rating IS NULL AND author IS NULL AND review_date IS NULL"
    S["embedded_json_reviews"] = base + f""" SELECT page_id, rating, title, review_text, review_date, author, NULL::VARCHAR AS verified FROM ({record})
      WHERE (review_text IS NOT NULL OR title IS NOT NULL) AND NOT ({badge})"""
    overall = f"""CASE WHEN overall_rating = '4.3' THEN '4.3' WHEN {n} % 4 = 0 THEN '3' END"""
    S["overall_rating"] = base + f" SELECT review_ord AS page_id, {overall} AS overall_rating FROM reviews"
    esc = "replace(replace(replace(replace(replace(review_text, '\\', '/'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'é', '&eacute;')"
    S["feed_to_markup"] = base + f""" SELECT review_ord, CASE {n} % 3
        WHEN 0 THEN '<div class="BVRRReview">' || replace(review_text, '\\', '/') || '</div>' || chr(10) || 'x'
        WHEN 1 THEN '<div class="BVRRReview">' || replace(review_text, '\\', '/') || '</div>'
        ELSE 'just <text> </p>' END AS markup FROM reviews WHERE review_text IS NOT NULL"""
    S["saved_pages_job"] = base + f""",
      found AS (
        SELECT model_id, rating, title, review_text, review_date, author, {overall} AS overall_rating, page_id
        FROM ({record}) r JOIN (SELECT review_ord, overall_rating FROM reviews) o ON o.review_ord = r.page_id
        WHERE page_id % 4 < 2 AND (review_text IS NOT NULL OR title IS NOT NULL) AND NOT ({badge})
        UNION ALL
        SELECT model_id, {number('rating')}, {clean('title')}, {clean('review_text')}, {clean('review_date')}, CASE WHEN {n} % 4 = 1 THEN {clean("'by ' || author")} ELSE {clean('author')} END,
               CASE WHEN {n} % 4 = 1 AND rating IS NOT NULL THEN ['5', '1', '3', '2.5', '4', NULL, NULL, NULL, '1'][{n} % 9 + 1] END, review_ord
        FROM reviews WHERE review_ord % 4 >= 2 AND ({clean('review_text')} IS NOT NULL OR {clean('title')} IS NOT NULL)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, coalesce(rating, ''), lower(coalesce(title, '')), lower(coalesce(review_text, '')),
                                              coalesce(review_date, ''), lower(coalesce(author, '')) ORDER BY page_id) AS rn FROM found)
      SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1""".replace("{n}", n)
    captured = base + """,
      r AS (SELECT *, CASE WHEN review_ord % 7 = 0 THEN 1 WHEN starts_with(site, 'b') THEN 2 ELSE 3 END AS source_rank FROM reviews),
      t AS (SELECT model_id, site, CASE WHEN starts_with(site, 'bby') THEN 0 ELSE min(source_rank) END AS best FROM r GROUP BY model_id, site)"""
    S["sources_used"] = captured + """ SELECT t.model_id, t.site, best::INTEGER AS source_rank, count(r.review_ord)::BIGINT AS n_records
      FROM t LEFT JOIN r ON r.model_id = t.model_id AND r.site = t.site AND r.source_rank = best GROUP BY ALL
      UNION ALL SELECT DISTINCT model_id, 'asked only', 2, 0 FROM t"""
    S["source_precedence_status"] = captured + " SELECT review_ord, source_rank FROM r JOIN t USING (model_id, site) WHERE source_rank = best"
    S["carried_rating"] = base + f""",
      p AS (SELECT review_ord AS page_id, model_id, {overall} AS own FROM reviews),
      f AS (SELECT model_id, min(page_id) AS at, arg_min(own, page_id) AS r FROM p WHERE own IS NOT NULL GROUP BY model_id),
      m AS (SELECT model_id, '4.' || CAST(count(*) % 10 AS VARCHAR) AS r FROM reviews WHERE model_id IN ('A7', 'C8') GROUP BY model_id)
      SELECT p.page_id, p.model_id, coalesce(m.r, CASE WHEN p.page_id >= f.at THEN f.r END) AS overall_rating
      FROM p LEFT JOIN f USING (model_id) LEFT JOIN m USING (model_id)"""
    S["source_precedence"] = base + """,
      r AS (SELECT *, CASE WHEN review_ord % 7 = 0 THEN 1 WHEN starts_with(site, 'b') THEN 2 ELSE 3 END AS source_rank FROM reviews)
      SELECT review_ord, source_rank FROM (SELECT *, min(source_rank) OVER (PARTITION BY model_id, site) AS best FROM r) WHERE source_rank = best"""
    return S


def source_statements() -> dict:
    """Answers from the rows that were written."""
    S = {}
    base = with_(reviews_cte())
    cols = ["model_id", "model_name", "size", "channel", "site", "source_url", "overall_rating", "rating", "title", "review_text", "review_date", "author", "verified", "scraped_at"]
    S["read_reviews"] = base + " SELECT review_ord, " + ", ".join(
        f"CASE WHEN review_ord % 4 < 2 THEN {c} ELSE NULL END AS {c}" if c in ("verified", "overall_rating") else c for c in cols) + " FROM reviews"
    S["normalize_schema"] = base + " SELECT review_ord, " + ", ".join(f"'' AS {c}" if c in ("author", "size") else c for c in cols) + " FROM reviews"
    S["latest_snapshot"] = base + " SELECT review_ord, model_id, 'v2' AS version FROM reviews"
    S["taxonomy_long"] = """WITH w AS (SELECT doc_id // 20 AS r, doc_id % 20 AS c, regexp_extract(text, '^\\s*(\\S+)', 1) AS phrase FROM documents)
      SELECT 'Topic ' || c AS category, c::INTEGER AS cat_ord, phrase,
             (row_number() OVER (ORDER BY c, r) - 1)::INTEGER AS phrase_ord FROM w WHERE phrase <> ''"""
    v, n = "CAST((review_ord // 2) % 60 + 40 AS VARCHAR)", "(review_ord // 2)"
    S["size_and_rating_text"] = base + f""" SELECT review_ord,
        CASE WHEN {n} % 4 <> 3 AND {v} IN ('40', '43', '50', '55', '58', '65', '70', '75', '85', '98') THEN {v} || '寸' END AS size_text,
        CASE {n} % 5 WHEN 0 THEN CASE WHEN {n} % 7 < 5 THEN CAST({n} % 7 AS VARCHAR) || '.25' END WHEN 1 THEN '1'
                     WHEN 2 THEN CASE WHEN {n} % 9 < 5 THEN CAST({n} % 9 AS VARCHAR) || '.5' END END AS overall_text FROM reviews"""
    key = S_key()
    S["lookup_cache_store"] = base + f""",
      e AS (SELECT {key} AS cache_key, model_id AS "primary", CASE WHEN review_ord % 6 <> 0 THEN site END AS secondary, review_ord % 4 < 2 AS early FROM reviews),
      one AS (SELECT cache_key, min(("primary", secondary)) AS v FROM e WHERE early AND "primary" IS NOT NULL AND secondary IS NOT NULL GROUP BY cache_key),
      two AS (SELECT cache_key, min(("primary", coalesce(secondary, 'second'))) AS v FROM e WHERE "primary" IS NOT NULL AND cache_key NOT IN (SELECT cache_key FROM one) GROUP BY cache_key)
      SELECT cache_key, v[1] AS "primary", v[2] AS secondary FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""
    return S


def sql_function_statements() -> dict:
    d = review_date_ts()
    return {"sql_functions": with_(reviews_cte()) + f"""
      SELECT review_ord, {nk('title')} AS k_title, {match_norm('review_text')} AS match_text, {rating_num('rating')} AS rating_num,
             strftime({d}, '%Y-%m-%d') AS review_day, {week_label(f'CAST({d} AS DATE)')} AS week,
             {size_expr(('title', 'review_text'))} AS size_display
      FROM reviews"""}


def message_statements() -> dict:
    base = with_(analysis_ctes(), taxonomy_cte()) + _items_cte() + _responses_cte()
    return {"message_text": base + f" SELECT batch_id, NULLIF({strip('content')}, '') AS content FROM responses"}


def labeled_detail_statements() -> dict:
    return {"labeled_detail": with_(_labeled_ctes()) + f"""
      SELECT review_ord, model_id, size, review_date, primary_label, secondary_label,
             row_number() OVER (PARTITION BY model_id ORDER BY {parse_date('review_date')} DESC NULLS LAST, review_ord)::BIGINT AS seq
      FROM labeled"""}


def scorer_statements() -> dict:
    base = with_(analysis_ctes(), taxonomy_cte()) + _items_cte()
    hit = "contains(lower(coalesce(title, '') || ' ' || coalesce(review_text, '')), 'refund')"
    return {
        "classify_with_function": base + f"""
          SELECT item_id, review_ord, CASE WHEN {hit} THEN 'Service' ELSE 'Other' END AS "primary",
                 CASE WHEN {hit} THEN 'refund' ELSE 'Please add comments' END AS secondary, 'scored' AS reason
          FROM items""",
        "translate_with_function": with_(analysis_ctes()) + """
          SELECT review_ord, '[' || CAST(length(issue_summary) AS VARCHAR) || '] ' || issue_summary AS translated
          FROM low""",
    }


def report_grid_statements() -> dict:
    size_all = size_expr(("title", "review_text"))
    base = with_(analysis_ctes(), classified_cte()) + f""",
counts AS (SELECT model_id, "primary", count(*) AS n, min(review_ord) AS first_ord FROM classified
           WHERE model_id IS NOT NULL GROUP BY model_id, "primary"),
summary AS (
  SELECT c.model_id, c."primary", c.n AS n_issues, round(c.n / sum(c.n) OVER (PARTITION BY c.model_id), 6) AS share,
         coalesce(k.keywords, '') AS keywords,
         row_number() OVER (PARTITION BY c.model_id ORDER BY c.n DESC, c.first_ord) AS issue_rank
  FROM counts c LEFT JOIN kw k ON k.category = c."primary"),
models AS (SELECT DISTINCT model_id FROM summary),
header AS (
  SELECT model_id, count(*) AS total_reviews, count(*) FILTER (WHERE rating_num <= 3) AS low_reviews
  FROM rated WHERE model_id IN (SELECT model_id FROM models) GROUP BY model_id),
m AS (SELECT *, upper(coalesce(channel, '')) AS ch,
             CASE WHEN upper(coalesce(channel, '')) = 'AMZ' THEN '全部' ELSE {size_all} END AS sz,
             {rating_num('overall_rating')} AS overall_num
      FROM rated WHERE model_id IN (SELECT model_id FROM models) AND upper(coalesce(channel, '')) IN ('AMZ', 'BBY')),
metrics AS (
  SELECT model_id, ch AS channel, sz AS size,
         coalesce({_first_non_empty('model_name')}, {_first_non_empty('model_id')}, '') AS model_name,
         round_even(coalesce(arg_min(overall_num, review_ord) FILTER (WHERE overall_num IS NOT NULL), avg(rating_num)), 1) AS avg_rating,
         count(*) AS n_reviews
  FROM m GROUP BY model_id, ch, sz),
sizes AS (
  SELECT h.*, coalesce(nm.n, 0) AS n_metrics, coalesce(ns.n, 0) AS n_summary, coalesce(nm.n, 0) + 9 AS s0
  FROM header h LEFT JOIN (SELECT model_id, count(*) AS n FROM metrics GROUP BY model_id) nm USING (model_id)
  LEFT JOIN (SELECT model_id, count(*) AS n FROM summary GROUP BY model_id) ns USING (model_id)),
details AS (
  SELECT model_id, model_name, channel, rating, coalesce(strftime({review_date_ts()}, '%Y-%m-%d'), '') AS review_date,
         secondary, '' AS reason, review_text,
         row_number() OVER (PARTITION BY model_id ORDER BY {review_date_ts()} DESC NULLS LAST, review_ord) AS seq
  FROM classified),
grid AS (
  SELECT model_id AS sheet, 0 AS row_idx, model_id || ' 低分评论问题分析' AS cells FROM sizes
  UNION ALL SELECT model_id, 1, '来源文件: reviews' FROM sizes
  UNION ALL SELECT model_id, 2, '总评论数（1-5星）: ' || total_reviews FROM sizes
  UNION ALL SELECT model_id, 3, '3星及以下评论数: ' || low_reviews FROM sizes
  UNION ALL SELECT model_id, 4, '' FROM sizes
  UNION ALL SELECT model_id, 5, '渠道评分与评论数' FROM sizes
  UNION ALL SELECT model_id, 6, '渠道 | 尺寸 | 机型名称 | 总评分 | 评论数' FROM sizes
  UNION ALL SELECT model_id, n_metrics + 7, '' FROM sizes
  UNION ALL SELECT model_id, n_metrics + 8, '' FROM sizes
  UNION ALL SELECT model_id, s0, '低分问题分类汇总' FROM sizes
  UNION ALL SELECT model_id, s0 + 1, '问题分类 | 问题数 | 问题占比 | 代表关键词' FROM sizes
  UNION ALL SELECT model_id, s0 + 2 + n_summary, '' FROM sizes
  UNION ALL SELECT model_id, s0 + 3 + n_summary, '' FROM sizes
  UNION ALL SELECT model_id, s0 + 4 + n_summary, '机型名称 | Channel | 评分 | 评论日期 | 问题分类 | 分类理由 | 评论内容' FROM sizes
  UNION ALL SELECT model_id, 6 + row_number() OVER (PARTITION BY model_id ORDER BY channel, size),
         channel || ' | ' || size || ' | ' || model_name || ' | ' || coalesce(CAST(avg_rating AS VARCHAR), '') || ' | ' || n_reviews
         FROM metrics
  UNION ALL SELECT s.model_id, z.s0 + 1 + s.issue_rank,
         s."primary" || ' | ' || s.n_issues || ' | ' || CAST(s.share AS VARCHAR) || ' | ' || s.keywords
         FROM summary s JOIN sizes z USING (model_id)
  UNION ALL SELECT d.model_id, z.s0 + 4 + z.n_summary + d.seq,
         coalesce(d.model_name, '') || ' | ' || coalesce(d.channel, '') || ' | ' || coalesce(d.rating, '') || ' | ' || d.review_date
         || ' | ' || coalesce(d.secondary, '') || ' | ' || d.reason || ' | ' || coalesce(d.review_text, '')
         FROM details d JOIN sizes z USING (model_id)
)"""
    return {"report_tables": base + " SELECT sheet, CAST(row_idx AS BIGINT) AS row_idx, cells FROM grid"}
