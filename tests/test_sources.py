"""Sources, sinks and streaming replay."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from revlens import fixtures
from revlens.operators.dedupe import keep_first
from revlens.sources import sinks
from revlens.sources.reviews import latest_snapshot, read_captured_pages, read_reviews
from revlens.sources.taxonomy import taxonomy_long
from revlens.streaming.jobs import StreamMerge
from tests.conftest import SMALL


def test_taxonomy_long_from_wide(spark):
    wide = spark.createDataFrame([(0, " dead pixel ", "refund", None), (1, None, " ", "x"), (2, "lines", "box", None)],
                                 "row long, `Picture ` string, Service string, `Unnamed: 3` string")
    got = [tuple(r) for r in taxonomy_long(wide, "row").orderBy("phrase_ord").collect()]
    assert got == [("Picture", 0, "dead pixel", 0), ("Picture", 0, "lines", 1), ("Service", 1, "refund", 2),
                   ("Service", 1, "box", 3)]


def test_taxonomy_long_numbers_a_long_sheet_in_many_tasks(spark):
    """Twenty columns, all of them kept, and no window without partition keys over the phrases."""
    n, cols = 500, [f"c{i}" for i in range(20)]
    wide = spark.range(n).select(F.col("id").alias("row"), *[F.when(F.col("id") % 3 != i % 3, F.concat(F.lit(c + " "), F.col("id"))).alias(c) for i, c in enumerate(cols)])
    df = taxonomy_long(wide.repartition(8), "row")
    want = [(c, i, f"{c} {r}") for i, c in enumerate(cols) for r in range(n) if r % 3 != i % 3]
    got = df.orderBy("phrase_ord").collect()
    assert [tuple(r) for r in got] == [(*w, k) for k, w in enumerate(want)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_read_reviews_skips_parts_without_keys(spark):
    d = tempfile.mkdtemp()
    spark.createDataFrame([("A7", "ok", "x")], "model_id string, review_text string, extra string").write.parquet(d + "/p1")
    spark.createDataFrame([("A7",)], "model_id string").write.parquet(d + "/p2")
    df = read_reviews(spark, [d + "/p1", d + "/p2"])
    assert df.count() == 1 and "extra" not in df.columns and df.first().title == ""


def test_latest_snapshot_ignores_temporary_copies(spark):
    d = tempfile.mkdtemp()
    for name in ("reviews_1", "reviews_2", "reviews__deduped_tmp"):
        os.makedirs(os.path.join(d, name))
        time.sleep(0.05)
    assert latest_snapshot(spark, d).endswith("reviews_2")


def test_read_captured_pages(spark):
    d = tempfile.mkdtemp()
    os.makedirs(os.path.join(d, "A7"))
    with open(os.path.join(d, "A7", "page2.html"), "w") as fh:
        fh.write("<html>\n<p>two</p>\n</html>")
    with open(os.path.join(d, "A7", "notes.txt"), "w") as fh:
        fh.write("skip")
    got = read_captured_pages(spark, d).collect()
    assert len(got) == 1 and got[0].model_id == "A7" and "<p>two</p>" in got[0].html


def test_cache_store_appends_only_new_keys(spark):
    path = tempfile.mkdtemp() + "/cache"
    e1 = spark.createDataFrame([("k1", "A", "a"), ("k2", None, "b")], "cache_key string, primary string, secondary string")
    sinks.save_cache(e1, path)
    sinks.save_cache(spark.createDataFrame([("k1", "Z", "z"), ("k3", "C", "c")], e1.schema), path)
    got = {r.cache_key: r.primary for r in sinks.load_cache(spark, path).collect()}
    assert got == {"k1": "A", "k3": "C"}                      # k2 malformed, k1 not overwritten


def test_stream_merge_replay_adds_nothing(spark):
    raw = fixtures.reviews(spark, SMALL)
    base = tempfile.mkdtemp()
    job = StreamMerge(spark, base)
    job.initialise(raw.filter(F.col("review_ord") % 2 == 0))
    batch = raw.filter(F.col("review_ord") % 2 == 1)
    job._batch(batch, 0)
    n = job.result().count()
    job._batch(batch, 0)                                       # replay of the same batch id
    job._batch(batch, 1)                                       # same rows again under a new id
    assert job.result().count() == n == keep_first(raw).count()


def test_stream_merge_reads_only_the_key_partitions_of_a_batch(spark):
    raw = fixtures.reviews(spark, SMALL)
    job = StreamMerge(spark, tempfile.mkdtemp(), bits=7)
    job.initialise(raw)
    batch = raw.filter("review_ord in (0, 1, 20)")
    new = job.new_rows(batch.unionByName(batch.limit(1).withColumn("title", F.lit("not seen before"))), 0)
    assert [r.title for r in new.collect()] == ["not seen before"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_prefix" in plan.split("PartitionFilters: [")[-1].split("]")[0]


def test_stream_merge_totals_after_a_crash(spark):
    """A batch that dies half-way (rows written, then the job fails) is replayed; totals hold."""
    raw = fixtures.reviews(spark, SMALL)
    job = StreamMerge(spark, tempfile.mkdtemp())
    job.initialise(raw.filter(F.col("review_ord") % 3 == 0))
    part = raw.filter(F.col("review_ord") % 3 == 1)
    job._batch(part.limit(5), 0)                               # the crashed attempt left some of its rows
    job._batch(part, 0)
    job._batch(raw.filter(F.col("review_ord") % 3 == 2), 1)
    stats = {r.batch_id: (r.total, r.added) for r in job.batch_stats().collect()}
    assert stats[1][0] == job.result().count() == keep_first(raw).count()
    assert stats[0][1] + stats[1][1] + stats[-1][0] == stats[1][0]


def test_ordinals_are_unique_over_many_partitions(spark):
    d = tempfile.mkdtemp()
    for part in ("a", "b"):
        spark.range(400).selectExpr("cast(id as string) model_id", "'x' review_text").repartition(150).write.parquet(f"{d}/{part}")
    old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    try:
        df = read_reviews(spark, [f"{d}/a", f"{d}/b"])
        assert df.rdd.getNumPartitions() > 256
        assert df.select("review_ord").distinct().count() == 800
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])


def test_cache_entry_without_label_does_not_block_its_key(spark):
    path, schema = tempfile.mkdtemp() + "/cache", "cache_key string, primary string, secondary string"
    spark.createDataFrame([("k", None, "b")], schema).write.parquet(path)  # as left by an older writer
    sinks.save_cache(spark.createDataFrame([("k", "A", "a")], schema), path)
    assert [tuple(r) for r in sinks.load_cache(spark, path).collect()] == [("k", "A", "a")]


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    import pytest
    from revlens.session import shared_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)), "x")


def test_stream_dedupe_bursts(spark, tmp_path):
    import datetime as dt
    from revlens.streaming.jobs import StreamDedupe
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, u, t0 + dt.timedelta(minutes=m)) for i, (u, m) in enumerate([("a", 0), ("a", 30), ("a", 85), ("a", 146), ("b", 10), ("b", 400), ("b", 460), ("a", 1000), ("a", 1000)])]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    job = StreamDedupe(spark, str(tmp_path), ["user_id"])
    for part, cond in enumerate(("ts < '2025-01-01 01:00:00'", "ts >= '2025-01-01 01:00:00' and ts < '2025-01-01 08:00:00'", "ts >= '2025-01-01 08:00:00'")):
        df.filter(cond).write.parquet(f"{job.source}/{part}")
        job.run(df.schema)
    job.finish(df)
    assert sorted(r.event_id for r in job.result().collect()) == [0, 3, 4, 5, 7]
