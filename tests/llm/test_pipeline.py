"""Every stage of the pipeline on its own input, against brute-force versions."""

import os
from collections import Counter

import corpus_pipeline
from revlens.llm import mixing, quality, sharding
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as groups


def stored(spark, df, folder, name):
    df.write.parquet(os.path.join(folder, name))
    return spark.read.parquet(os.path.join(folder, name))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert seen == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(docs)
        docs = stored(spark, stage(spark, docs, SMALL), str(tmp_path), str(i))
        assert docs.columns[:len(columns)] == columns
    rows = [{r["doc_id"]: r for r in df.collect()} for df in (*kept, docs)]
    # quality
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(kept[0], spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert set(rows[1]) == {d for d, p in scores.items() if p}
    # near duplicates: the smallest of each group
    classes = groups([(d, r["text"]) for d, r in rows[1].items()])
    assert set(rows[2]) == {d for d, c in classes.items() if c[1] == d}
    # contaminated documents go
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(rows[3]) == {r[0] for r in contaminated([(d, r["text"]) for d, r in rows[2].items()], items) if not r[5]}
    # mixing takes each document as often as the mix says, unchanged
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).collect()}
    assert Counter(r["doc_id"] for r in kept[4].collect()) == {d: n for d, n in copies.items() if n}
    assert all(rows[4][d] == rows[3][d] for d in rows[4])
    # sharding places every row
    table = {r["doc_id"]: (r["slot"], r["shard"]) for r in sharding.place(kept[4]).collect()}
    assert docs.count() == kept[4].count() and all((r["slot"], r["shard"]) == table[r["doc_id"]] for r in docs.collect())


def test_run_and_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    documents(spark, AWKWARD).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # without labels every score is 0.5, under the limit
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"] and docs.count() > 0
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
