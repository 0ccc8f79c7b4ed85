"""Review sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.functions.dates import format_date_or_raw
from revlens.functions.markup import natural_key
from revlens.functions.size import extract_size
from revlens.functions.text import py_strip
from revlens.schema import LABELED_REQUIRED, has_columns, normalize_schema, require_columns

KEY_COLUMNS = {"model_id", "review_text"}
TASK_BYTES = 32 << 20  # of saved pages for every task


def read_reviews(spark: SparkSession, paths, fmt: str = "parquet", required=KEY_COLUMNS) -> DataFrame:
    """Read every part, skip parts lacking the key columns, union by name, fix the schema.

    When a part carries no ``review_ord``, the rows of the union are numbered by Spark
    partition and position: the partitions of a union are those of its parts in order, so
    the numbers are unique and follow (part, place in the part)."""
    parts = []
    for p in paths:
        df = spark.read.format(fmt).option("header", True).load(p)
        if not has_columns(df, required):
            continue
        parts.append(df)
    if not parts:
        raise ValueError("no review part with the expected columns")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not all("review_ord" in p.columns for p in parts):
        rows = rows.withColumn("review_ord", F.monotonically_increasing_id())
    return normalize_schema(rows)


def read_classified(df: DataFrame) -> DataFrame:
    """Strict column check; blank labels -> 'Other'; size and date normalised."""
    require_columns(df, LABELED_REQUIRED)
    blank_other = lambda c: F.coalesce(F.nullif(py_strip(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("")),
                                       F.lit("Other"))
    return (df.withColumn("primary_label", blank_other("primary_label"))
            .withColumn("secondary_label", blank_other("secondary_label"))
            .withColumn("size", extract_size())
            .withColumn("review_date", format_date_or_raw("review_date")))


def latest_snapshot(spark: SparkSession, folder: str, skip=("__deduped_tmp", "_deduped")) -> str | None:
    """Newest snapshot folder by modification time, ignoring temporary/fallback copies.

    Lists one folder level through the Hadoop file system (metadata only)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(folder)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    best, best_t = None, -1
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if any(s in name for s in skip) or name.startswith((".", "_")):
            continue
        if st.getModificationTime() > best_t:
            best, best_t = st.getPath().toString(), st.getModificationTime()
    return best


def _decoded(files):
    """File contents as text; bytes that are no UTF-8 are left out."""
    for content in files:
        yield pa.array([None if b is None else b.decode("utf-8", "ignore") for b in content.to_pylist()], pa.string())


def read_captured_pages(spark: SparkSession, folder: str, glob: str = "*.htm*") -> DataFrame:
    """One row per saved page file: path, model_id (its parent folder's name), file_name, file_key (for
    natural order, O4) and html.  Bytes that are no UTF-8 are left out, the rest of the page stays; Spark's scan
    leaves out files without any bytes.  Files are read by as many tasks as their bytes (TASK_BYTES) or the cores
    ask for: a scan of small files makes a task of every few of them."""
    def decode(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _decoded(files)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    pages = files.select("path", part(-2).alias("model_id"), part(-1).alias("file_name"), F.arrow_udf(decode, "string")(F.col("content")).alias("html"))
    return pages.withColumn("file_key", natural_key("file_name"))
