"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from revlens.session import fresh_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back: it runs once,
    later plans are short, and a lost executor costs only its own tasks."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value) -> Broadcast:
    """Broadcast of an object of this package that travels with its class (by value), so executors
    need no installed copy; ``unpacked`` opens it inside a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(shared: Broadcast):
    return pickle.loads(shared.value)
