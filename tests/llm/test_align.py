"""Cross-tokenizer alignment against a plain version that walks tokens one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from revlens.llm import align, piece_codec
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents

PARTS = [" ", "  ", "\n", "\n ", " \n", "a", "the", " the", "é", "ü ", "😀", "\t", "\r\n", "<|endoftext|>", "</s>", "<0x0A>", "<unk>", "中", "　", " ", "ing", "'re", "123", "...", "x y"]


@pytest.fixture(scope="module")
def models():
    with open(align.MODEL_A, "rb") as f, open(align.MODEL_B, "rb") as g:
        return f.read(), g.read()


def plain(models, texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] by definition."""
    a, b = align.byte_level(models[0]), piece_codec.processor(models[1])
    of_a, of_b = (x.to_pylist() for x in align.token_bytes(*models))
    docs = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for i in ids_a) != want or b"".join(of_b[i] for i in ids_b) != want:
            docs.append(([], [], [], []))
            continue
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        groups, common, at = [], sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}), 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if at <= s and e <= stop) for side in spans))
            at = stop
        docs.append((ids_a, ids_b, links, groups))
    count = Counter(p for _, _, links, _ in docs for p in set(links))
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    return [(len(x), len(y), len(g), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), ";".join(g)) for x, y, links, g in docs]


def check(spark, models, docs, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(d, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for (d, _), w in zip(rows, plain(models, [t for _, t in rows]))]
    got = [tuple(r) for r in align.align(docs, **more).select("doc_id", *align.COUNTS, "n_best", "count_sum", "groups_sha256").collect()]
    key = lambda t: (t[0] is None, t)
    assert sorted(got, key=key) == sorted(want, key=key)


def mixed(n, seed, parts=PARTS):
    r = random.Random(seed)
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 40, align.TABLE_PAIRS])
def test_random_and_awkward_texts_at_any_bound_of_the_table(spark, models, limit):
    rows = [r for r in AWKWARD if len(r[1] or "") < 1000] + [(50, "a ▁ b"), (51, "long " * 400), (52, "x" * 3000), (51, "again")]
    check(spark, models, documents(spark, rows + [(100 + i, t) for i, t in mixed(150, 2)]).selectExpr("*", "1 pair", "2 n", "3 _row", "4 spaced"), limit=limit)


def test_given_documents(spark, models):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000 or text is null")
    check(spark, models, docs)


def test_groups_as_text(spark, models):
    rows = mixed(40, 7)
    out = {r["doc_id"]: r["groups"] for r in align.tokens_aligned(documents(spark, rows), groups=True).collect()}
    assert out == {d: w[-1] for (d, _), w in zip(rows, plain(models, [t for _, t in rows]))}


def test_words_are_segmented_as_in_whole_texts(models):
    import pyarrow as pa
    from revlens.llm.chunk_table import Segmenter, break_after_word

    texts = [" " + t for _, t in mixed(3000, 11)]
    sides = Segmenter(align.opened(*models, break_after_word), break_after_word)(pa.array(texts))
    whole = align.byte_level(models[0]).encode_batch(texts, add_special_tokens=False)
    pieces = piece_codec.processor(models[1]).encode([t[1:] for t in texts])
    for (ids, offsets), want in zip(sides, ([e.ids for e in whole], pieces)):
        assert [ids[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:])] == want


def test_unusual_tokenizer_gets_whole_texts(spark, models, monkeypatch):
    monkeypatch.setattr(align, "splits_words", lambda model: False)
    check(spark, models, documents(spark, mixed(60, 5)))


def test_empty_table_and_nothing_but_empty_texts(spark, models):
    assert align.align(documents(spark, [])).count() == 0
    check(spark, models, documents(spark, [(1, None), (2, ""), (None, "")]))
