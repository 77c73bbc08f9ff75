"""Whitening against exact integer sums and NumPy's own covariance."""

import random

import numpy as np
import pytest

pytest.importorskip("cohortspan.llm")

from cohortspan.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, n int, _z string")


def brute(rows, most=32):
    """Straight from the contract: integers, exact deviation, covariance centred before multiplying."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[(n * r[k] - s[k]) / n for k in range(d)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def check(got, rows, most=32):
    deviation, white, explained = brute(rows, most)
    assert len(got) == len(rows) * len(explained)
    by = {(r.vec_id, r.component): r for r in got}
    mine = np.array([[by[i, k + 1].whitened for k in range(len(explained))] for i, _ in rows])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-6
    for (i, _), dev in zip(rows, deviation):
        assert by[i, 1].deviation == dev and by[i, 1].n == len(rows)
    assert np.allclose([by[rows[0][0], k + 1].explained for k in range(len(explained))], explained, rtol=1e-6)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(mine.T @ mine / len(rows) - np.eye(len(explained))).max() < 1e-6


def test_cross_products_are_exact():
    rnd = np.random.default_rng(3)
    for n, span in ((1, 5), (63, 2), (64, 100), (130, 2**40), (5000, 70), (40, 2**61)):
        z = rnd.integers(-span, span, (n, 5))
        z[:, 3] = 7  # no plane at all
        sums, products = whitening.cross_products(z)
        rows = z.tolist()
        assert sums == [sum(r[k] for r in rows) for k in range(5)]
        assert products == {(i, j): sum(r[i] * r[j] for r in rows) for i in range(5) for j in range(i, 5)}
        value = products[0, 0] - 2**70
        limbs = whitening._limbs(value)
        assert sum(v << (whitening.LIMB * k) for k, v in enumerate(limbs)) == value


def test_whiten_matches_numpy(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1 + k) + (rnd.random() if k % 2 else 0) for k in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # repeated rows
    bad = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []),
           (2005, [1.0, 2.0]), (2006, [3e18] + [0.0] * 5)]
    table = vectors(spark, rows + bad).repartition(5)
    check(whitening.whiten(table).collect(), rows)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64 * 48)
    check(whitening.whiten(table, most=3).collect(), rows, 3)


def test_whiten_far_from_zero_and_wide(spark):
    rnd = random.Random(2)
    rows = [(i, [float(np.float32(rnd.gauss(1e6 * k, 2000.0))) for k in range(40)]) for i in range(120)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    check(got, rows)
    assert max(r.component for r in got) == 32
    far = [(i, [4e14 * (-1) ** i + i * 1e13, float(i)]) for i in range(9)]
    assert {r.deviation for r in whitening.whiten(vectors(spark, far)).collect()} == {None}


def test_whiten_degenerate(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(None, [])]):
        got = whitening.whiten(vectors(spark, rows))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(10)]  # rank one
    got = whitening.whiten(vectors(spark, [(None, v) for _, v in flat[:2]] + flat[2:])).collect()
    assert [r.component for r in got] == [1] * 10 and got[0].explained == pytest.approx(1.0) and sum(r.vec_id is None for r in got) == 2


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, SF).collect(), rows)
