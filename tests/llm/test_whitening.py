"""Whitening and its eigensolver against NumPy and whole numbers."""

import math

import numpy as np
import pytest

from neurotab.llm import eigen, queries, whitening

RNG = np.random.default_rng(3)
BASE = np.linalg.qr(RNG.standard_normal((40, 40)))[0]
GLUED = np.kron(np.eye(2), np.diag(np.abs(np.arange(-10.0, 11))) + np.eye(21, k=1) + np.eye(21, k=-1))
MATRICES = {
    "random": np.cov(RNG.standard_normal((300, 40)).T), "diagonal": np.diag(np.arange(30.0)), "identity": np.eye(20), "zero": np.zeros((4, 4)),
    "repeated values": BASE @ np.diag([5.0] * 15 + [3] * 10 + [1] * 15) @ BASE.T, "steep": BASE @ np.diag(10.0 ** -np.arange(40)) @ BASE.T,
    "ones": np.ones((25, 25)), "one": np.array([[2.0]]), "two": np.array([[2.0, 1], [1, 2]]), "glued": GLUED,
    "small": 1e-200 * np.cov(RNG.standard_normal((300, 40)).T), "negative": -GLUED,
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenpairs(name):
    a = MATRICES[name]
    for k in (1, 12, len(a), len(a) + 3):
        values, x = eigen.leading_eigenpairs(a, k)
        k = min(k, len(a))
        scale = np.abs(a).max() or 1
        assert values.shape == (k,) and x.shape == (len(a), k)
        assert np.allclose(values / scale, np.linalg.eigvalsh(a)[::-1][:k] / scale, rtol=0, atol=1e-13)
        assert np.abs(x.T @ x - np.eye(k)).max() < 1e-13
        assert np.abs(a @ x - x * values).max() / scale < 1e-13


def test_sturm_count():
    d, e, _ = eigen.tridiagonal(MATRICES["random"])
    values = np.linalg.eigvalsh(MATRICES["random"])
    assert eigen.sturm_count(d, e, np.r_[values - 1e-9, values + 1e-9]).tolist() == [*range(40), *range(1, 41)]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    expected = c @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    got = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 32 * n
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = [math.copysign(1, by[rows[0]["vec_id"], k + 1]["whitened"] * expected[0, k]) for k in range(32)]
    for i, row in enumerate(rows):
        for k in range(32):
            r = by[row["vec_id"], k + 1]
            assert r["n"] == n and r["deviation"] == ((n * x[i] - s) ** 2).sum()
            assert r["whitened"] == pytest.approx(sign[k] * expected[i, k], abs=1e-9)
            assert r["explained"] == pytest.approx(values[::-1][k] / np.trace(cov), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def whitened(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "embedding array<float>, whitened string, vec_id long")
    model = whitening.fit(docs, **kw)
    return model, [(r["vec_id"], r["deviation"], r["whitened"]) for r in whitening.whiten(model).collect()]


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    good = [([float(a), float(b), 1.0], "x", i) for i, (a, b) in enumerate([(0, 0), (2, 1), (4, -1), (6, 5), (6, 5)])]
    bad = [(None, "x", 100), ([], "x", 101), ([1.0, None, 2.0], "x", 102), ([nan, 1.0, 1.0], "x", 103), ([inf, 1.0, 1.0], "x", 104), ([1.0, 2.0], "x", 105)]
    model, got = whitened(spark, good + bad + [([1.0, 1.0, 1.0], "y", None), ([1.0, 1.0, 1.0], "y", 0)])
    assert model.n == 7 and len(model.values) == 2  # the third entry never varies
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(False, 0), (False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    w = np.array([r[2] for r in got])
    assert np.allclose(w.T @ w / 7, np.eye(2)) and np.allclose(w.mean(0), 0) and whitening.identity_error(model) < 1e-12
    same = {tuple(r[2]) for r in got if r[0] in (3, 4)}
    assert len(same) == 1


def test_no_rows_and_no_spread(spark):
    for rows in ([], [(None, "x", 1)], [([float("nan")], "x", 1)]):
        model, got = whitened(spark, rows)
        assert got == [] and model.n == 0 and whitening.identity_error(model) == 0 if rows == [] else got == []
    model, got = whitened(spark, [([1.0, 2.0], "x", 1)] * 3)
    assert model.n == 3 and [(r[0], r[1], r[2]) for r in got] == [(1, 0, [])] * 3
    # of two lengths equally often the longer one takes part
    model, got = whitened(spark, [([1.0], "x", 1), ([2.0], "x", 2), ([1.0, 2.0], "x", 3), ([2.0, 1.0], "x", 4)])
    assert sorted(r[0] for r in got) == [3, 4] and len(model.values) == 1


def test_large_entries(spark):
    """Beyond what float64 products hold, and beyond 64 bits of deviation."""
    rows = [([1e9 * k, 3e9 * (k % 3)], "x", k) for k in range(10)]
    model, got = whitened(spark, rows)
    x = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in r[0]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    for i, deviation, _ in got:
        exact = sum((10 * a - b) ** 2 for a, b in zip(x[i], s))
        assert deviation == (exact if exact < 1 << 63 else None)
    assert any(d is None for _, d, _ in got)
    assert model.covariance[0, 0] == (10 * sum(a[0] * a[0] for a in x) - s[0] ** 2) / 100
    with pytest.raises(Exception, match="62 bits"):
        whitened(spark, [([1e30], "x", 1)])
    assert (whitening.exact_products(np.array([[1 << 30, -3], [5, 1 << 40]])) == np.array([[(1 << 60) + 25, (5 << 40) - (3 << 30)], [(5 << 40) - (3 << 30), (1 << 80) + 9]], object)).all()
