"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session we build ourselves.  A session handed to
# us (for example by a cluster launcher) is used as it is.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "revlens", extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A folder for materialised tables and checkpoints.

    On a cluster this is below the shared folder named by
    ``spark.checkpoint.dir``, or else the checkpoint folder already set on the
    context.  Only on a local master (one machine, as in tests) with neither of
    them do we pick a scratch folder ourselves and record it in the session; on
    any other master that is an error, because executors would not share it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="revlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(base, "rdd-checkpoints"))
    return os.path.join(base.rstrip("/"), purpose)


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing sub folder of the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark, purpose), uuid.uuid4().hex)


SPREAD_BYTES = 64 << 20  # of input for every core


def spread(df, *keys: str):
    """The rows dealt over all cores by ``keys`` if the input has less than SPREAD_BYTES for each: a
    scan splits files at row groups, and a small table is often one.  Larger inputs are left as
    the scan splits them.  This only decides which task handles a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * SPREAD_BYTES else df


def materialize(df):
    """Reliable checkpoint into the shared folder (``spark.checkpoint.dir``) that cuts the
    lineage.  The rows are persisted while the checkpoint is written, so the plan runs
    once instead of twice; afterwards only the checkpoint files are used."""
    shared_dir(df.sparkSession, "checkpoints")
    kept = df.persist()
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


def written(df, purpose: str):
    """``df`` as Parquet in the shared folder, read back: for rows with long texts that several jobs read,
    each of them only the columns it needs."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
