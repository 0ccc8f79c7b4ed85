"""Personal data: base spans against a plain restatement, candidates, trees, redaction."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import pii
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    kinds, need = list(PATTERNS), {"email": "@", "phone": "+"}  # a plain search of a long text without the sign takes for ever
    return sorted((m.start(), kinds.index(k), m.end()) for k, p in PATTERNS.items() if need.get(k, "") in (text or "")
                  for m in re.finditer(p, text or "") if passes(k, m.group()))


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


TRICKY = [
    "call +1 (988) 555-2485 or x@y.z.w@q.e and 4041 8949 7460 8795 or 4041-8949-7460-8795, 4041--8949",
    "1.2.3.4.5.6.7.8.999 1.2.3.400 0255.1.1.1 1.1.1.00000000000000000000255 1.2.3", "a.b_@c.d_e@f.g a@b-.c..d a@b a@b. @x.y é@x.y", "+1()2 +12345678 +123456789 +1 2 3 456789012 +1-",
    "1 " * 30_000 + "a@" + "b." * 30_000 + "c +" + "1" * 5000, "x" * 20_000 + "😀 +49 (30) 1234567 😀 ab@cd.ef", "12345678901234567890 4041894974608795\n4041894974608795",
    "private  4041894974608795 ab@c.d", "4539 1488 0343 6467 79927398713 000000000000",
]


def check(got, rows):
    texts = [(d, t) for d, t, *_ in rows]
    assert len(got) == len(texts)
    want = sorted((str(d), hashlib.sha256(written(base(t)).encode()).hexdigest(), *[sum(k == x[1] for x in base(t)) for k in range(4)]) for d, t in texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    by_id = {}
    for d, t in texts:
        by_id.setdefault(d, set()).update(written([x]) for x in base(t))
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        assert len(set(spans)) == len(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    return by_id


def test_base_spans(spark):
    rows = [(100 + i, t) for i, t in enumerate(TRICKY)] + AWKWARD
    docs = documents(spark, rows).withColumnRenamed("lang", "base").withColumnRenamed("source", "spans")
    check(pii.report(docs).collect(), rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(pii.report(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def corpus():
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} now or mail user.{i}@mail{i % 9}.example.com, thanks") for i in range(150)]
    rows += [(1000 + i, f"order 10{i:06d} of 2024-01-{i % 28 + 1:02d}, {i}.{i % 7}.13 and 12,{i:03d} units, 1234-5678") for i in range(150)]
    return rows + [(5000, "fax (312) 555-0142, then"), (5001, "write to jane (at) mail1 (dot) com today"), (5002, "on 2023-11-05 version 1.22.333 order 20231105123"), (5003, "is at home. The 2001-2002 season")]


def test_candidates_add_spans_and_leave_plain_numbers(spark):
    rows = corpus()
    got = pii.report(documents(spark, rows)).collect()
    check(got, rows)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[5000] == "phone:4:18" and spans[5001] == "email:9:34" and spans[5002] == spans[5003] == ""
    assert not any(spans[1000 + i] for i in range(150))


def test_redaction(spark):
    docs = documents(spark, [(7001, "a b@c.de f +49 30 1234567"), (7002, None), *corpus()])
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[7001] == "a [EMAIL] f [PHONE]" and out[7002] is None and out[5002] == dict(corpus())[5002]


def test_empty_table(spark):
    assert pii.report(documents(spark, [])).count() == 0


def test_trees_learn_and_match_their_expression(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 9, (400, len(pii.FEATURES)))
    y = ((x[:, 1] > 4) ^ (x[:, 5] > 6)).astype(float)
    trees = pii.Trees(x[:300], y[:300], np.ones(300)).calibrate(x[300:], y[300:], np.ones(100), np.zeros(100))
    assert np.mean((trees.predict(x[300:]) > 0.5) == y[300:]) > 0.95 and trees.thresholds[0] < 1 and trees.thresholds[1] == 2.0
    df = spark.createDataFrame([tuple(map(int, row)) for row in x[:50]], ",".join(f"{f} int" for f in pii.FEATURES))
    got = [row[0] for row in df.select(F.struct("*").alias("f")).select(trees.column(F.col("f"))).collect()]
    assert got == pytest.approx(trees.predict(x[:50]).tolist())


def candidate_rows(spark, n):
    """Numbers without a check at first, address-like base spans in the last tenth."""
    mail = F.col("id") >= n - n // 10
    values = {f: F.lit(0) for f in pii.FEATURES} | {"gen": mail.cast("int"), "nd": F.when(mail, 0).otherwise(7 + F.col("id") % 2).cast("int"),
                                                    "dots": F.when(mail, 1).otherwise(0), "tld": F.when(mail, 3).otherwise(0), "before": (F.col("id") % 4).cast("int")}
    f = F.struct(*[values[name].alias(name) for name in pii.FEATURES])
    return spark.range(n).select(F.col("id").alias("h"), F.struct(f.alias("f"), F.when(mail, 0).otherwise(3).alias("k"), mail.alias("known")).alias("c"))


def test_trees_learn_from_every_candidate(spark):
    trees = pii.train(candidate_rows(spark, 30_000))
    assert trees.thresholds[0] < 1 and trees.thresholds[3] == 2.0


def test_sums_of_a_table_are_those_of_its_rows(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 9, (300, len(pii.FEATURES)))
    y = (x[:, 2] > 4) | (x[:, 7] > 6)
    n = r.integers(1, 50, 300)
    ddl = f"f struct<{','.join(f'{f}:int' for f in pii.FEATURES)}>, known boolean, n long"
    cells = spark.createDataFrame([(tuple(map(int, a)), bool(b), int(c)) for a, b, c in zip(x, y, n)], ddl)
    trees = pii.Trees(x, y.astype(float), n)
    assert trees.start == pii.Trees().fit(lambda *_: [], n @ y, n.sum()).start
    for tree in (pii._Open(), [7, 6, [2, 4, pii._Open(), 0.5], pii._Open()]):
        got = {tuple(c[:3]): c[3:] for c in pii._CellSums(cells)(trees, tree)}
        want = {tuple(map(int, c[:3])): c[3:] for c in pii._array_sums(x, y, n)(trees, tree)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
