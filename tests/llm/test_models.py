"""Language identification and quality classifier: held-out accuracy, gradients, defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import language, quality
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents, prose

MIDDLE = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert rows.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [d for d in rows if rows[d]["held_out"]]
    assert np.mean([rows[d]["lang_pred"] == truth[d] for d in held]) > 0.98


def gram_counts(text):
    """The buckets of a text, one n-gram at a time."""
    from collections import Counter

    s, out = " " + " ".join(text.lower().split()) + " ", Counter()
    for n in language.GRAMS:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i:i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2 ** 64
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2 ** 64
            out[h >> 50] += 1
    return out


def test_language_matches_plain_naive_bayes(spark):
    rows = [(i, f"{'the of and' if i % 2 else 'der und die'} {prose(6, i)} é", "en" if i % 2 else "de", "s") for i in range(40)] + [(99, "und the", None, "s")]
    got = {r["doc_id"]: r for r in language.identify(documents(spark, rows).drop("lang").join(
        spark.createDataFrame([(r[0], r[2] if len(r) > 3 else None) for r in rows], "doc_id long, lang string"), "doc_id")).collect()}
    train = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    tables, docs = {}, {}
    for lang in ("de", "en"):
        table = np.full(language.BUCKETS, language.SMOOTHING)
        for r in train:
            if r[2] == lang:
                for b, n in gram_counts(r[1]).items():
                    table[b] += n
        tables[lang], docs[lang] = np.log(table / table.sum()), sum(r[2] == lang for r in train)
    for doc, text, *_ in rows:
        counts = gram_counts(text)
        like = {k: sum(n * t[b] for b, n in counts.items()) for k, t in tables.items()}
        best = max(like, key=lambda k: like[k] + np.log(docs[k] / len(train)))
        scale = min(1.0, language.EVIDENCE / sum(counts.values()))
        part = {k: np.exp(scale * (like[k] - like[best])) * docs[k] for k in like}
        assert got[doc]["lang_pred"] == best and got[doc]["score"] == pytest.approx(part[best] / sum(part.values()))


def test_language_awkward_rows(spark):
    rows = AWKWARD + [(20, "123 !? ² ½"), (21, "é")]
    train = [(100 + i, "hello there friend", "en") for i in range(9)] + [(200 + i, "bonjour à tous", "fr") for i in range(9)]
    docs = documents(spark, rows + train)
    got = language.identify(docs.withColumnRenamed("n_chars", "row").withColumnRenamed("source", "score")).collect()
    assert len(got) == len(rows) + len(train)
    unknown = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert unknown == {1, 2, 3, 4, 20} and all(r["score"] == 0 for r in got if r["doc_id"] in unknown)


def test_more_languages_than_a_block(spark):
    """1001 languages, each with words of its own: every training text finds its language."""
    rows = [(3000 + i, " ".join(f"{prose(2, i)}q{i}" for _ in range(6)), f"l{i:04}", "s") for i in range(3003) if zlib.crc32(str(3000 + i).encode()) % 3 != 1][:1001]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(documents(spark, rows)).collect()}
    assert np.mean([got[r[0]][0] == r[2] for r in rows]) > 0.98


def test_language_blocks_give_what_one_matrix_gives(spark, monkeypatch):
    rows = [(i, f"{prose(8, i % 7)} {prose(5, i)}", f"l{i % 7}", "s") for i in range(60)]
    want = {r["doc_id"]: r for r in language.identify(documents(spark, rows)).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 2)
    for r in language.identify(documents(spark, rows)).collect():
        assert r["lang_pred"] == want[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(want[r["doc_id"]]["score"])


def test_language_without_labels_or_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "hello")]).withColumn("lang", F.lit(None).cast("string"))
    assert [tuple(r)[2:] for r in language.identify(docs).collect()] == [("und", 0.0)]
    assert language.identify(documents(spark, [])).count() == 0


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_gradient():
    r = np.random.default_rng(0)
    first = np.array([0, 3, 4, 9])
    x, y, weight = r.normal(size=(9, quality.FEATURES)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = quality.Model(x.mean(0), x.std(0) + 0.1)

    def loss():
        p = model.score(x, first)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()
    grad = model.gradient(x, first, y, weight)
    for name, g in grad.items():
        at = tuple(r.integers(0, n) for n in g.shape)
        old = model.w[name].copy()
        sides = []
        for step in (1e-5, -1e-5):
            model.w[name] = old.copy()
            model.w[name][at] += step
            sides.append(loss())
        model.w[name] = old
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_passages_cover_whole_texts():
    texts = ["", "one two", " ".join(["w"] * 65), "A b! " * 64, None, "x" * 1000]
    x, first = quality.passages(pa.array(texts))
    assert np.diff(first).tolist() == [1, 1, 2, 2, 1, 1]
    assert not x[0].any() and x[2, -1] == pytest.approx(np.log1p(64) / 5) and x[3, -1] == pytest.approx(np.log1p(1) / 5)
    assert x[2, 66] == pytest.approx(63 / 64)  # 66: words equal to the one before
    alone, _ = quality.passages(pa.array([texts[3]]))
    assert np.allclose(alone, x[4:6])


def plain_features(text):
    """The features of a text's passages, byte by byte and word by word."""
    import re

    data, kinds = (text or "").encode(), quality.KIND
    words = list(re.finditer(rb"[^\t\n\x0b\f\r ]+", data))
    out = []
    for at in range(0, max(1, len(words)), quality.PASSAGE):
        some = words[at:at + quality.PASSAGE]
        begin = 0 if at == 0 else some[0].start()
        stop = words[at + quality.PASSAGE].start() if at + quality.PASSAGE < len(words) else len(data)
        cells = np.zeros(quality.CLASSES ** 2)
        for x, y in zip(data[begin:stop], data[begin + 1:stop]):
            cells[kinds[x] * quality.CLASSES + kinds[y]] += 1
        n = max(1, len(some))
        low = [w[0].lower() for w in some]
        sizes = np.array([len(w[0]) for w in some] or [0.0])
        firsts, lasts = [kinds[w[0][0]] for w in some], [kinds[w[0][-1]] for w in some]
        share = lambda hits: sum(hits) / n
        stats = [sizes.mean() / 10 if some else 0, sizes.std() / 10 if some else 0, share(x == y for x, y in zip(low, low[1:])), len(set(low)) / n, share(k == 1 for k in firsts),
                 share(k == 6 for k in lasts), share(k == 4 for k in lasts), share(1 < k < 7 for k in firsts), np.log1p(len(some)) / 5]
        out.append(np.concatenate((cells / max(1, cells.sum()), stats)))
    return np.array(out)


def plain_score(model, x):
    """Gated attention over the passages of one text, written out."""
    w, encoded, weights = model.w, [], []
    for row in x:
        h = np.tanh(np.clip((row - model.mean) / model.scale, -8, 8) @ w["E"] + w["e"])
        encoded.append(h)
        weights.append(np.exp(w["w"] @ (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"]))))))
    z = sum(a * h for a, h in zip(weights, encoded)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))


def test_quality_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts = documents(spark, AWKWARD[:6] + AWKWARD[8:]).unionByName(docs)
    model = quality.train(docs, labels)
    got = texts.select("doc_id", "text", quality.score(texts["text"], model).alias("s")).collect()
    assert all(r["s"] == pytest.approx(plain_score(model, plain_features(r["text"])), abs=1e-5) for r in got)


def test_quality_learns_from_every_passage_of_a_chosen_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels, shares: seen.append(sorted(map(len, bags))))
    long = " ".join(f"w{i}" for i in range(64 * 90))
    docs = documents(spark, [(1, long), (3, "a b"), (4, "c"), (5, None)])
    labels = spark.createDataFrame([(d, d % 2, 0) for d in (1, 3, 4, 5)], "doc_id long, quality int, toxic int")
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 2)
    quality.train(docs, labels)
    known = [d for d in (1, 3, 4, 5) if zlib.crc32(str(d).encode()) % 4 != 2]
    sizes = {1: 90, 3: 1, 4: 1, 5: 1}
    assert seen[0] == sorted(sizes[d] for d in known) and set(seen[1]) <= set(seen[0]) and len(seen[1]) >= len({d % 2 for d in known})


def test_quality_awkward_rows(spark):
    good = [(100 + i, prose(60, i) + ". Fine sentence here.", "en") for i in range(60)]
    bad = [(300 + i, "JUNK!! " * 40, "en") for i in range(60)]
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good] + [(d, 0, 0) for d, *_ in bad] + [(None, 1, 0), (101, 0, 0), (7, None, 0), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(spark, AWKWARD + good + bad).withColumnRenamed("lang", "row").withColumnRenamed("source", "score")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([by_id[d] for d, *_ in good]) > 0.95 and np.mean([by_id[d] for d, *_ in bad]) < 0.05
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.classify(documents(spark, [(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert quality.classify(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(documents(spark, [(1, "a"), (2, "b")]), one).count() == 2
    assert spark.read.parquet(f"{SMALL}/labels.parquet").columns == none.columns
