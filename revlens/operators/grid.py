"""Report sheets as cell grids (S11) and tables found again in them (G1).

A sheet is a set of rows ``(sheet, row_idx, cells array<string>)``.  The
writer stacks the sections of a model report the way a spreadsheet would;
the reader finds a table by its heading row and reads until a blank row or a
section title.  Both are plain DataFrame jobs keyed by sheet: per-sheet
positions are aggregates (one row per sheet) joined back, never a list of a
sheet's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from revlens.operators.sequence import sequence
from revlens.schema import ORD

# Section titles and the headings of the report tables.
METRICS_TITLE = "渠道评分与评论数"
SUMMARY_TITLE = "低分问题分类汇总"
STOP_TITLES = [METRICS_TITLE, SUMMARY_TITLE]
METRICS_HEAD = ["渠道", "尺寸", "机型名称", "总评分", "评论数"]
SUMMARY_HEAD = ["问题分类", "问题数", "问题占比", "代表关键词"]
DETAIL_HEAD = ["机型名称", "Channel", "评分", "评论日期", "问题分类", "分类理由", "评论内容"]


def _cells(*cols):
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in cols])


def report_grid(header: DataFrame, metrics: DataFrame, summary: DataFrame, details: DataFrame) -> DataFrame:
    """One grid per model.  Inputs: ``header`` (model_id, total_reviews, low_reviews),
    ``metrics`` (A2), ``summary`` (A1 with issue_rank), ``details`` (low rows with seq).

    Four branches: the fixed rows of every sheet (titles, headings, blank rows) come from
    one explode per model; metrics, summary and detail rows are placed by offsets taken
    from the per-model section sizes."""
    n_m = metrics.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_metrics"))
    n_s = summary.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_summary"))
    sizes = (header.join(n_m, "model_id", "left").join(n_s, "model_id", "left").fillna(0, ["n_metrics", "n_summary"])
             .withColumn("s0", F.col("n_metrics") + 9))  # summary title row

    def row(idx, *cells):
        return F.struct(idx.cast("long").alias("row_idx"),
                        F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).cast("array<string>").alias("cells"))

    blank = lambda idx: F.struct(idx.cast("long").alias("row_idx"), F.array().cast("array<string>").alias("cells"))
    s0, nm, ns = F.col("s0"), F.col("n_metrics"), F.col("n_summary")
    fixed = sizes.select(F.col("model_id").alias("sheet"), F.explode(F.array(
        row(F.lit(0), F.concat(F.col("model_id"), F.lit(" 低分评论问题分析"))),
        row(F.lit(1), "来源文件: reviews"),
        row(F.lit(2), F.concat(F.lit("总评论数（1-5星）: "), F.col("total_reviews").cast("string"))),
        row(F.lit(3), F.concat(F.lit("3星及以下评论数: "), F.col("low_reviews").cast("string"))),
        blank(F.lit(4)),
        row(F.lit(5), METRICS_TITLE),
        row(F.lit(6), *METRICS_HEAD),
        blank(nm + 7), blank(nm + 8),
        row(s0, SUMMARY_TITLE),
        row(s0 + 1, *SUMMARY_HEAD),
        blank(s0 + 2 + ns), blank(s0 + 3 + ns),
        row(s0 + 4 + ns, *DETAIL_HEAD))).alias("r")).select("sheet", "r.row_idx", "r.cells")

    def rows(df, idx, cells):
        return df.select(F.col("model_id").alias("sheet"), idx.cast("long").alias("row_idx"), cells.alias("cells"))

    # a model has one metrics row per channel and size: a small window per model
    m_rows = rows(metrics.withColumn("_i", F.row_number().over(Window.partitionBy("model_id").orderBy("channel", "size"))),
                  F.col("_i") + 6, _cells("channel", "size", "model_name", "avg_rating", "n_reviews"))
    offsets = sizes.select("model_id", "s0", "n_summary")
    s_rows = rows(summary.join(offsets, "model_id"), s0 + 1 + F.col("issue_rank"),
                  _cells("primary", "n_issues", "share", "keywords"))
    d_rows = rows(details.join(offsets, "model_id"), s0 + 4 + ns + F.col("seq"),
                  _cells("model_name", "channel", "rating", "review_date", "secondary", "reason", "review_text"))
    return fixed.unionByName(m_rows).unionByName(s_rows).unionByName(d_rows)


def grid_tables(grid: DataFrame, required, wanted, stop_titles=STOP_TITLES) -> DataFrame:
    """G1: the first table per sheet whose heading row holds all ``required`` headings;
    rows until the next blank row or section title; columns named by the headings
    (blank headings dropped).  Returns ``sheet, row_idx`` and the ``wanted`` columns."""
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    g = grid.withColumn("_t", trimmed)
    req = F.array(*[F.lit(r) for r in required])
    stops = F.array(*[F.lit(s) for s in stop_titles])
    head = (g.filter(F.size(F.array_except(req, F.col("_t"))) == 0)
            .groupBy("sheet").agg(F.min(F.struct("row_idx", "_t")).alias("h"))
            .select("sheet", F.col("h.row_idx").alias("h_idx"), F.col("h._t").alias("headings")))
    blank = F.size(F.filter("_t", lambda c: c != "")) == 0
    titled = F.size(F.array_intersect("_t", stops)) > 0
    after = g.join(head, "sheet").filter(F.col("row_idx") > F.col("h_idx"))
    ends = (after.filter(blank | titled).groupBy("sheet").agg(F.min("row_idx").alias("e_idx")))
    body = (after.join(ends, "sheet", "left")
            .filter(F.col("e_idx").isNull() | (F.col("row_idx") < F.col("e_idx")))
            .filter(~blank))
    # heading -> cell, blank headings dropped
    pairs = F.filter(F.arrays_zip(F.col("headings").alias("k"), F.col("cells").alias("v")), lambda p: p["k"] != "")
    # of headings that repeat the last one counts
    cell = lambda w: F.try_element_at(F.filter(pairs, lambda p: p["k"] == w), F.lit(-1))["v"]
    return body.select("sheet", "row_idx", *[cell(w).alias(w) for w in wanted])
