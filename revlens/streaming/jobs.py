"""Structured Streaming forms of merge, weekly trend and dedupe.

All three read a file source (new parquet files landing in a folder), keep
their checkpoints and outputs below the shared folder, and are idempotent on
replay: a micro-batch that is run again after a failure writes nothing new.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from revlens.functions.dates import iso_week_label
from revlens.operators.dedupe import KEY, keep_first, with_key
from revlens.schema import DEDUPE_KEYS, ORD
from revlens.streaming.keystore import BITS, PREFIX, prefix, unseen

BATCH = "_batch_id"


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


class StreamMerge:
    """Keep-first merge of incoming review files into a stored table.

    ``stored`` is a parquet folder holding duplicate-free rows plus the key digest, in partitions
    by batch and by the digest's first bits; each micro-batch is de-duplicated in itself,
    anti-joined with the stored keys of the partitions it hits and written to a partition folder
    of its own.  Added and total follow from the stored rows, so they cannot differ from
    them; a replayed batch adds nothing."""

    def __init__(self, spark: SparkSession, base: str, keys=DEDUPE_KEYS, bits: int = BITS):
        self.spark, self.base, self.keys, self.bits = spark, base, keys, bits
        self.stored = os.path.join(base, "stored")
        self.checkpoint = os.path.join(base, "checkpoint")

    def initialise(self, existing: DataFrame) -> None:
        first = with_key(keep_first(existing, self.keys), self.keys)
        self._write(first, -1, "errorifexists")

    def _write(self, rows: DataFrame, batch_id: int, mode: str) -> None:
        dealt = rows.withColumn(PREFIX, prefix(F.col(KEY), self.bits)).repartition(PREFIX)  # a folder is written by one task
        dealt.write.mode(mode).partitionBy(PREFIX).parquet(os.path.join(self.stored, f"{BATCH}={batch_id}"))

    def new_rows(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch's rows whose key is stored by no other batch."""
        stored = batch.sparkSession.read.parquet(self.stored).filter(F.col(BATCH) != batch_id)
        return unseen(with_key(keep_first(batch, self.keys), self.keys), stored, KEY, self.bits)

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        """A batch writes its own partition folder and nothing else, and a replay replaces that
        folder, so a crash at any point leaves rows and totals in step."""
        self._write(self.new_rows(batch, batch_id), batch_id, "overwrite")

    def run(self, source: str, schema: StructType, files_per_batch: int | None = None) -> None:
        """Process the files that landed since the last run (one batch unless capped)."""
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = reader.parquet(source)
        q = (stream.writeStream.foreachBatch(self._batch)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        _run(q)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.stored).drop(KEY, BATCH, PREFIX)

    def batch_stats(self) -> DataFrame:
        """(batch_id, added, total), counted from the stored rows; one row per batch."""
        added = self.spark.read.parquet(self.stored).groupBy(F.col(BATCH).cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.orderBy("batch_id")
        return added.select("batch_id", F.when(F.col("batch_id") >= 0, F.col("n")).alias("added"), F.sum("n").over(w).alias("total"))


def weekly_counts_stream(events: DataFrame, key: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events per ISO week (Monday start) and key with a watermark.

    ``window(ts, '7 days', '7 days', '4 days')``: epoch day 0 is a Thursday, so a
    4-day offset makes windows start on Mondays.  ``withWatermark`` needs a
    TIMESTAMP, so TIMESTAMP_NTZ input is cast first."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (t.groupBy(F.window("_ts", "7 days", "7 days", "4 days").alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(iso_week_label(F.col("w.start").cast("date")).alias("week"), key,
                    F.col("n_events").cast("bigint").alias("n_events")))


class StreamWeekly:
    """T2 runner: update-mode batches are upserted (latest count per week and key wins)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.updates = os.path.join(base, "updates")
        self.checkpoint = os.path.join(base, "checkpoint")

    def run(self, source: str, schema: StructType, key: str, ts: str = "ts", delay: str = "1 day",
            glob: str | None = None) -> None:
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        stream = reader.parquet(source)
        agg = weekly_counts_stream(stream, key, ts, delay)

        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(self.updates)

        q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        _run(q)

    def result(self, key: str) -> DataFrame:
        u = self.spark.read.parquet(self.updates)
        latest = u.groupBy("week", key).agg(F.max(F.struct("batch_id", "n_events")).alias("l"))
        return latest.select("week", key, F.col("l.n_events").alias("n_events"))


def dedupe_stream(events: DataFrame, keys, ts: str = "ts", delay: str = "1 hour", order: str = "event_id") -> DataFrame:
    """The first event of every burst: events of one key follow each other in gaps of at
    most ``delay``, and a burst ends with the first longer gap.  State per key is one
    open burst, dropped when the watermark passes its end; ties go to the smaller ``order``."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (t.groupBy(*keys, F.session_window("_ts", delay).alias("w"))
            .agg(F.min(F.struct("_ts", order)).alias("first"))
            .select(F.col(f"first.{order}").alias(order), *keys))


def first_seen_stream(events: DataFrame, keys, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """T3, immediate form: an event passes at once unless one of its key was seen within the delay; the
    state of a key is dropped when the watermark passes its last event plus ``delay``."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(list(keys))


class StreamFirstSeen:
    """T3 immediate runner.  Rows without keys do not count; files are taken in the order of their
    names, so each batch holds what landed next."""

    def __init__(self, spark: SparkSession, base: str, keys, delay: str = "1 hour"):
        self.spark, self.keys, self.delay = spark, list(keys), delay
        self.source, self.out, self.checkpoint = (os.path.join(base, d) for d in ("in", "out", "checkpoint"))

    def run(self, schema: StructType, ts: str = "ts") -> None:
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(self.source)
        keyed = stream.dropna(subset=self.keys)
        q = (first_seen_stream(keyed, self.keys, ts, self.delay).drop("_ts").writeStream.format("parquet").option("path", self.out)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        _run(q)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.out)


class StreamDedupe:
    """T3 runner: every closed burst's first event is appended once.  ``run`` processes the
    files that landed in time order; ``finish`` lands one row without keys that is later
    than all events, which closes the open bursts."""

    def __init__(self, spark: SparkSession, base: str, keys, delay: str = "1 hour", order: str = "event_id"):
        self.spark, self.keys, self.delay, self.order = spark, list(keys), delay, order
        self.source, self.out, self.checkpoint = (os.path.join(base, d) for d in ("in", "out", "checkpoint"))

    def run(self, schema: StructType, ts: str = "ts") -> None:
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(self.source)
        q = (dedupe_stream(stream, self.keys, ts, self.delay, self.order).writeStream.format("parquet").option("path", self.out)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        _run(q)

    def finish(self, events: DataFrame, ts: str = "ts") -> None:
        last = events.agg((F.max(F.col(ts).cast("timestamp")) + F.expr(f"interval {self.delay}") * 3).alias("t"))
        row = last.filter("t is not null").select(*[F.col("t").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
        row.write.parquet(os.path.join(self.source, "end"))
        self.run(events.schema, ts)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.out).filter(F.col(self.keys[0]).isNotNull()).select(self.order, *self.keys)
