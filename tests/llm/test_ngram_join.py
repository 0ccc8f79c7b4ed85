"""N-gram Jaccard join against brute force, and its defined results."""

import numpy as np

from revlens.llm import graph, membership, ngram_join
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents, jaccard, prose, shingles, words


def brute(rows):
    """Rows whose doc_id repeats hold one text here."""
    texts = {}
    for doc, text in rows:
        if doc is not None:
            texts[doc] = max(texts.get(doc, ""), text or "")
    rep, out = {}, {}
    for doc in sorted(texts):
        rep.setdefault(tuple(words(texts[doc])) or ("", doc), doc)
    text_id = {d: rep[tuple(words(t)) or ("", d)] for d, t in texts.items()}
    sets = {d: shingles(texts[d]) for d in set(text_id.values())}
    ids = sorted(d for d in sets if sets[d])
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    for d in texts:
        out[d] = (text_id[d], root(text_id[d]), links[text_id[d]])
    return out


def result(df):
    rows = df.collect()
    out = {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(ngram_join.jaccard_join(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def near_copies(n, seed=1):
    base = prose(200, seed).split()
    out = []
    for i in range(n):
        copy = list(base)
        for k in range(i % 5):
            copy[(i * 37 + k * 53) % 200] = f"edit{i}x{k}"
        out.append((1000 + i, " ".join(copy)))
    return out


def test_hot_group_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # the group of copies then spans several blocks
    rows = near_copies(90) + [(i, prose(80, i)) for i in range(40)] + [(2000 + i, prose(200, 1)) for i in range(50)]
    assert result(ngram_join.jaccard_join(documents(spark, rows))) == brute(rows)


def test_shorter_prefixes_until_recall(spark, monkeypatch):
    seen = []
    found = ngram_join._links_at
    monkeypatch.setattr(ngram_join, "_links_at", lambda *a: seen.append(a[2]) or found(*a))
    ngram_join.jaccard_join(documents(spark, near_copies(30)), recall=0.999999).count()
    assert seen == [5, 4, 3]
    assert ngram_join.met(0.8, 5) < ngram_join.met(0.8, 4) < ngram_join.met(0.8, 3)


def test_hot_group_does_not_end_the_search(spark):
    """A pair at 0.81 that shares no prefix of five, beside a group of links near 1."""
    base, hot = prose(99, 4293).split(), prose(200, 1)
    other = [f"e4293{'ab'[i > 30]}" if i in (30, 60) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(other))] + [(100 + i, f"{hot} last{i}") for i in range(40)]
    got = result(ngram_join.jaccard_join(documents(spark, rows)))
    assert got == brute(rows) and got[2] == (2, 1, 1)


def test_awkward_rows_have_defined_results(spark):
    got = result(ngram_join.jaccard_join(documents(spark, AWKWARD).withColumnRenamed("n_chars", "class_id")))
    assert got == brute(AWKWARD)
    assert got[1] == (1, 1, 0) and None not in got


def test_unlike_texts_of_one_document_all_count(spark):
    a, b = prose(100, 1), prose(100, 2)
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b + " y"), (4, prose(100, 3)), (0, b), (9, None), (9, "few words"), (9, "")]
    got = result(ngram_join.jaccard_join(documents(spark, rows)))
    classes = {d: c for d, (_, c, _) in got.items()}
    assert classes == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 9: 9}
    assert {d: n for d, (_, _, n) in got.items()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 0, 9: 0}
    assert got[0][0] == 0 and got[1][0] in (0, 1) and got[4][0] == 4


def test_a_recall_out_of_reach_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        ngram_join.jaccard_join(documents(spark, [(1, "a b")]), threshold=0.1, recall=0.9999)


def test_empty_table(spark):
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got[i] for i in range(301)) == {0} and set(got[i] for i in range(1000, 1100)) == {1000} and got[5000] == 5000


def test_membership(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)] + [(None,)], "k long")
    ids = spark.createDataFrame([(i,) for i in range(0, 1000, 7)] * 2, "x long")
    assert sorted(r["k"] for r in membership.among(df, "k", ids).collect()) == list(range(0, 1000, 7))
    assert membership.outside(df, "k", ids).count() == 1001 - 143


def test_signature_estimates_jaccard():
    import pyarrow as pa

    a, b = prose(2000, 3).split(), prose(2000, 3).split()
    b[::25] = [f"z{i}" for i in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(a), " ".join(b)])], ["doc_id", "text"])
    sig = ngram_join._signature_rows(next(iter(ngram_join._signatures([batch]))).column("sig"))
    assert abs(np.mean(sig[0] == sig[1]) - jaccard(shingles(" ".join(a)), shingles(" ".join(b)))) < 0.15
