"""Embedding whitening against numpy's eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from revlens.llm import whitening
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], f"vec_id long, embedding {kind}")


def plain(rows, wanted=4):
    """{vec_id: [(deviation, whitened up to sign)]}, explained, from integers and numpy's eigh."""
    kept = [(i, [int(math.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, s = len(fit), fit.sum(0)
    centred = np.array([[float(Fraction(int(c)) - Fraction(int(t), n)) for c, t in zip(x, s)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    keep = values > 1e-13 * values[0]
    white = {}
    for i, x in kept:
        dev = sum((n * c - int(t)) ** 2 for c, t in zip(x, s))
        white.setdefault(i, []).append((dev, np.array([float(Fraction(c) - Fraction(int(t), n)) for c, t in zip(x, s)]) @ vectors[:, keep] / np.sqrt(values[keep])))
    return white, values[keep] / (np.trace(centred.T @ centred) / n), n


def check(out, rows, wanted=4, gaps=True):
    got = out.collect()
    white, explained, n = plain(rows, wanted)
    assert len(got) == sum(map(len, white.values())) * len(explained)
    sign = {}
    for c in range(1, len(explained) + 1):
        mine = [r for r in got if r["component"] == c]
        assert all(r["n"] == n and abs(r["explained"] - explained[c - 1]) < 1e-9 and r["identity_error"] < 1e-9 for r in mine)
        if gaps:
            big = max(mine, key=lambda r: abs(r["whitened"]))
            sign[c] = np.sign(big["whitened"] * white[big["vec_id"]][0][1][c - 1])
    for r in got:
        dev, w = white[r["vec_id"]][0]
        assert r["deviation"] == (dev if dev < 2 ** 63 else None)
        if gaps:
            assert abs(r["whitened"] - sign[r["component"]] * w[r["component"] - 1]) < 1e-8
    return got


def test_given_embeddings(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = check(whitening.whiten(df), rows)
    assert {r["component"] for r in got} == {1, 2, 3, 4}


def test_awkward_vectors(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.standard_normal(6) * [9, 5, 3, 2, 1, .5] + 100) for i in range(200)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[1][1])]
    bad = [(400, None), (401, [1, 2, None, 4, 5, 6]), (402, [NAN] * 6), (403, [1, 2, 3, INF, 5, 6]), (404, []), (405, [1, 2])]
    out = whitening.whiten(table(spark, rows + bad).selectExpr("*", "1 x", "2 n", "3 component"))
    check(out, rows)
    assert not {r["vec_id"] for r in out.collect()} & {b for b, _ in bad}


@pytest.mark.parametrize("rows", [
    [(0, [1, 0, 0]), (1, [-1, 0, 0]), (2, [0, 1, 0]), (3, [0, -1, 0]), (4, [0, 0, 1]), (5, [0, 0, -1])],  # all deviations equal
    [(0, [3, 0, 0, 0]), (1, [-3, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [0, -1, 0, 0]), (4, [0, 0, 1, 0]), (5, [0, 0, -1, 0])],  # two equal, one none
    [(0, [1, 2, 3]), (1, [2, 4, 6]), (2, [5, 10, 15])],  # rank one
    [(0, [1, 2]), (1, [3, 4])]])
def test_repeated_and_missing_deviations(spark, rows):
    check(whitening.whiten(table(spark, rows)), rows, gaps=False)


def test_no_variance_and_no_rows(spark):
    for rows in ([], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(1, None)], [(1, [])]):
        out = whitening.whiten(table(spark, rows))
        assert out.columns[:2] == ["vec_id", "component"] and out.count() == 0


def test_far_and_large_vectors_stay_exact(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.standard_normal(3) * [4e6, 2e6, 1e6] + 3e8).tolist()) for i in range(60)]
    check(whitening.whiten(table(spark, rows)), rows)


def test_early_end_gives_the_same_components(spark):
    random = np.random.default_rng(3)
    turn = np.linalg.qr(random.standard_normal((80, 80)))[0]
    spread = np.concatenate([[40, 40, 25, 16, 9], 0.5 ** np.arange(75)])
    rows = [(i, v.tolist()) for i, v in enumerate((random.standard_normal((300, 80)) * spread) @ turn)]
    check(whitening.whiten(table(spark, rows), check=16), rows)
