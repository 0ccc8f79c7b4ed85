"""Suffix-array decontamination against brute force, and its defined results."""

import hashlib

from revlens.llm import decontaminate
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents, prose, words


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[p:p + n]))
                if items_here:
                    found |= items_here
                    hit.update(range(p, p + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, prose(40, 900)), (2, prose(13, 901)), (3, "short item Of words"), (4, ""), (5, None), (None, prose(30, 902)), (6, prose(40, 900)), (7, "be")]


def planted():
    a, b = prose(40, 900).split(), prose(13, 901).split()
    rows = [(10, prose(300, 5) + " " + " ".join(a)), (11, " ".join(a[5:18]).upper() + "!" + prose(20, 6)), (12, " ".join(a[5:17])), (13, " ".join(b * 30)),
            (14, "x short, item OF words y " + prose(500, 7)), (15, prose(30, 902)), (16, "be " * 400), (17, " ".join(a) + "\n" + " ".join(a[::-1]))]
    return rows + AWKWARD


def test_planted_passages_match_brute_force(spark):
    got = decontaminate.report(documents(spark, planted()), bench(spark, ITEMS))
    assert result(got) == brute(planted(), ITEMS)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)  # several blocks, and rows written in between
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    got = decontaminate.report(documents(spark, planted()), bench(spark, ITEMS))
    assert result(got) == brute(planted(), ITEMS)


def test_longest_match_and_place(spark):
    a = prose(40, 900).split()
    rows = [(1, "q r " + " ".join(a[3:30]) + " s")]
    row = decontaminate.report(documents(spark, rows), bench(spark, ITEMS[:1])).first()
    assert (row["longest_match"], row["longest_at"], row["longest_item"]) == (27, 2, "1")


def test_removal_keeps_other_rows_and_clashing_columns(spark):
    docs = documents(spark, planted()).withColumnRenamed("n_chars", "found").withColumnRenamed("lang", "row")
    kept = decontaminate.decontaminate(docs, bench(spark, ITEMS))
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute(planted(), ITEMS) if not r[5]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark):
    assert decontaminate.report(documents(spark, []), bench(spark, ITEMS)).count() == 0
    rows = decontaminate.report(documents(spark, planted()), bench(spark, [])).collect()
    assert len(rows) == len(planted()) and not any(r["contaminated"] or r["n_items"] for r in rows)


def test_suffix_array_order_is_exact():
    import numpy as np
    import pyarrow as pa

    from revlens.llm import textbatch

    texts = ["a b a b a b c", "a b a", "b " * 50, "", "a b a b a b c", prose(300, 4, 6)]
    w = textbatch.Words(pa.array(texts))
    array = decontaminate.SuffixArray(w, 1000)
    suffixes = [tuple(array.text[i:].tolist()) for i in array.order]
    assert suffixes == sorted(suffixes)
    assert sorted(array.order.tolist()) == list(range(len(array.text))) and np.all(array.doc[array.order] >= 0)


def test_small_scale_matches_brute_force(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert result(decontaminate.report(docs, items)) == want
