"""Line dedup, mixing and sharding against brute force, and their defined results."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revlens.llm import line_dedup, mixing, sharding
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, LOWERED, documents

BLANKS = " \t\n\x0b\x0c\r"


def lines_brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWERED)
    order = lambda d: (d is None, d or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=order) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [(3, "A common line\nown text of three"), (1, " a COMMON line\t\nA common line\nshort"), (2, "a common line\nshort\n\nÉcole commune dix"), (2, "x\nyet another text of two\na common line"),
         (4, "école commune dix\nÉcole commune dix"), (None, "a common line"), (None, "only null holds this"), (7, "\x0ba common line\x0c"), (8, "a common line\u00a0"), *AWKWARD]


def test_lines_match_brute_force(spark):
    got = sorted([tuple(r) for r in line_dedup.report(documents(spark, LINES)).collect()], key=str)
    assert got == lines_brute(LINES)


def test_lines_dropped_in_place(spark):
    docs = documents(spark, LINES).withColumnRenamed("lang", "gone").withColumnRenamed("source", "first")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(LINES)
    texts = {(r["doc_id"], r["text"]) for r in out.where("doc_id in (3, 7, 8)").collect()}
    assert {(3, "own text of three"), (7, ""), (8, "a common line\u00a0")} <= texts and (7, "x" * 300_000) in texts
    assert out.where("doc_id = 1 and text is null").count() == 1


def test_hot_line_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rows = [(i, f"a very common line\nown line number {i // 2} of some\n{'rare pair line' if i in (5, 77) else 'x'}") for i in range(120)]
    got = sorted([tuple(r) for r in line_dedup.report(documents(spark, rows)).collect()], key=str)
    assert got == lines_brute(rows)


def test_lines_empty_table(spark):
    assert line_dedup.report(documents(spark, [])).count() == 0


def fill(sizes):
    """Targets by repeated clamping; sizes: source -> words, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = left - sum(3 * sizes[s] for s in clamped)
        aim = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if aim[s] > 3 * sizes[s]}
        if not over:
            return {s: aim.get(s, 3.0 * sizes[s]) for s in names}
        clamped |= over


def check_mix(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, biggest = Counter(), Counter()
    for doc, text, _, source in rows:
        totals[source] += size(text)
        biggest[source] = max(biggest[source], size(text))
    want, taken = fill(totals), Counter()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_id = {(r[0], r[1]): r for r in rows}
    for r in got:
        source = next(x[3] for x in rows if x[0] == r["doc_id"] and size(x[1]) == r["size"])
        assert r["source_size"] == totals[source] and r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert len(by_id) >= 1
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(2, len(rows) ** 0.5), (s, taken[s], want[s])


def test_mix_meets_targets(spark):
    rows = [(i, "word " * (1 + i * 7 % 40), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(400)] + [(1000, "a b", "en", None), (1001, None, "en", "null text"), (1002, "c", "en", "tiny")]
    check_mix(rows, documents(spark, rows))


def test_mix_reruns_agree_and_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(documents(spark, [(1, "", "en", "x")])).collect()] == [(1, 0, 0, 0.0, 0, 0)]


def test_repeat_takes_whole_rows(spark, monkeypatch):
    rows = [(i, "word " * 10, "en", f"s{i % 4}") for i in range(200)] + [(0, "word " * 10, "en", "s0")]
    docs = documents(spark, rows).withColumnRenamed("lang", "copies").withColumnRenamed("n_chars", "bin")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect()}
    for limit in (100_000, 0):  # broadcast, and the join for very many sources
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        out = mixing.repeat(docs)
        assert out.columns == docs.columns
        got = Counter(r["doc_id"] for r in out.collect())
        assert {k: v for k, v in want.items() if v} == dict(got)


def brute_table(names, size):
    orders = []
    for s in names:
        start, step = sharding._number(f"offset:{s}") % size, sharding._number(f"step:{s}") % (size - 1) + 1
        orders.append(iter([(start + k * step) % size for k in range(size)]))
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            if len(owner) < size:
                owner[next(x for x in order if x not in owner)] = i
    return [owner[x] for x in range(size)]


def test_lookup_table():
    for shards, size in ((1, 2), (3, 7), (7, 101), (64, 1009)):
        table = sharding.lookup_table(sharding.names(shards), size)
        assert table == brute_table(sharding.names(shards), size)
        counts = Counter(table)
        assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards
    few, more = sharding.lookup_table(sharding.names(20), 10_007), sharding.lookup_table(sharding.names(21), 10_007)
    assert sum(a != b for a, b in zip(few, more)) < 0.15 * 10_007
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_placement_matches_brute_force(spark):
    docs = documents(spark, AWKWARD).withColumnRenamed("lang", "slot").withColumnRenamed("source", "_key")
    table = sharding.lookup_table(sharding.names(sharding.SHARDS))
    out = sharding.place(docs)
    rows = out.collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        key = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + (r["text"] or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(documents(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    docs = documents(spark, [(i, f"t{i}") for i in range(300)])
    sharding.write_shards(docs, str(tmp_path / "out"), shards=8, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 8
