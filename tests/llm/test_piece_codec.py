"""SentencePiece encoding and decoding against the library on whole texts."""

import hashlib
import random
import struct

import pytest

from revlens.llm import chunk_table, piece_codec
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents

PARTS = [" ", "  ", "\n", "\n\n", "a", "the", " the", "▁", "é", "😀", "\t", "\r", "\x00", "<s>", "</s>", "<0x0A>", "<unk>", "中", "　", " ", "ing", "123", "..."]


@pytest.fixture(scope="module")
def library():
    with open(piece_codec.MODEL, "rb") as f:
        return piece_codec.processor(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def check(library, docs, out):
    key = lambda t: (t[0] is None, t)
    want = sorted(((r["doc_id"], *expected(library, r["text"])) for r in docs.select("doc_id", "text").collect()), key=key)
    assert sorted(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=key) == want


def mixed(n, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(30)))) for i in range(n)]


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(library, docs, piece_codec.report(docs))


@pytest.mark.parametrize("limit", [0, 2000, chunk_table.TABLE_BYTES])
def test_awkward_texts_at_any_bound_of_the_table(spark, library, limit):
    docs = documents(spark, AWKWARD + [(1000 + i, t) for i, t in mixed(500, 3)])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}  # the repeated doc_id holds one text
    rows = piece_codec.encode(docs, limit=limit).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{len(ids)}I", r["ids"])) == ids and r["decoded"] == library.decode(ids)


def test_random_texts(spark, library):
    docs = documents(spark, mixed(3000, 8))
    check(library, docs, piece_codec.report(docs))


def test_model_whose_pieces_may_cross_gets_whole_texts(spark, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "splits", lambda sp: False)
    docs = documents(spark, AWKWARD + mixed(300, 4))
    check(library, docs, piece_codec.report(docs))


def test_empty_table_and_clashing_columns(spark, library):
    empty = documents(spark, []).selectExpr("*", "1 ids", "2 decoded", "3 marked", "4 chunk")
    assert piece_codec.report(empty).count() == 0
    more = documents(spark, mixed(20, 5)).selectExpr("*", "1 ids", "2 decoded", "3 marked", "4 chunk")
    check(library, more, piece_codec.report(more))


def test_frequent_chunks_stay_within_the_bound(spark):
    texts = documents(spark, [(i, " a" * 50 + f" w{i}") for i in range(200)]).select("text")
    counts = chunk_table.chunk_counts(texts, chunk_table.every_break)
    assert {r["chunk"]: r["n"] for r in counts.collect()}[" a"] == 200 * 50
    kept = [r["chunk"] for r in chunk_table.frequent(counts, 1, 100).collect()]
    assert kept == [" a"]
    assert not chunk_table.frequent(counts, 1, 10).collect()
