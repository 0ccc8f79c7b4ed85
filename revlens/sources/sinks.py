"""Sinks (S8, S9, S12, S13): every write goes to a new folder below the shared
folder (``spark.checkpoint.dir``) or a caller-given path, never over a path that
is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.session import fresh_dir


def write_reviews_by_model(df: DataFrame, path: str, seq_col: str = "seq", files_per_task: int = 1) -> str:
    """One folder per model; rows range-partitioned on (model, seq) so a large model
    is written by many tasks; ``seq`` (newest first) carries the order."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (df.repartitionByRange(int(n), "model_id", seq_col)
       .sortWithinPartitions("model_id", seq_col)
       .write.mode("errorifexists").partitionBy("model_id").parquet(path))
    return path


def write_version(df: DataFrame, spark: SparkSession, purpose: str, fmt: str = "parquet") -> str:
    """Write to a new version folder and return it (the caller switches to it)."""
    path = fresh_dir(spark, purpose)
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def read_version(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def save_cache(entries: DataFrame, path: str, key: str = "cache_key") -> None:
    """S13 save: append only complete entries whose key has no complete entry yet (first entry
    per key), so a malformed entry never blocks its key."""
    spark = entries.sparkSession
    values = [c for c in entries.columns if c != key]
    new = entries.dropna(subset=values[:2])
    if _exists(spark, path):
        new = new.join(load_cache(spark, path, values[:2], key).select(key), key, "left_anti")
    first = new.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in entries.columns if c != key])).alias("_v"))
    first.select(key, "_v.*").write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_cache(spark: SparkSession, path: str, value_cols=("primary", "secondary"), key: str = "cache_key") -> DataFrame:
    """S13 load: entries with at least two non-empty label values (malformed ones dropped)."""
    df = spark.read.parquet(path)
    ok = None
    for c in value_cols:
        cond = F.col(c).isNotNull()
        ok = cond if ok is None else ok & cond
    return df.filter(ok)
