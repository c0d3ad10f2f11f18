"""Jacobi-Davidson against a dense eigensolver, and the contract's figures by exact arithmetic."""

import math

import numpy as np
import pytest

from knowntime.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int"


def run(spark, rows, most=32):
    return whitening.whiten(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA), most).collect()


def spectrum(rng, dim, values):
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize("dim, most", [(5, 32), (64, 32), (300, 12), (200, 1), (40, 40)])
def test_pairs(dim, most):
    rng = np.random.default_rng(dim)
    a, _ = spectrum(rng, dim, np.sort(rng.exponential(size=dim))[::-1] ** 2)
    products = []
    values, vectors = whitening.largest_pairs(lambda y: products.append(y.shape) or a @ y, dim, most)
    want = np.linalg.eigvalsh(a)[::-1][: min(most, dim)]
    assert np.allclose(values, want, rtol=0, atol=1e-12 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.sqrt(((a @ vectors - vectors * values) ** 2).sum(0)).max() <= 2e-13 * want[0]
    assert len(products) < 120


def test_equal_and_zero_values():
    rng = np.random.default_rng(1)
    a, _ = spectrum(rng, 90, np.r_[[5.0] * 7, [2.0] * 20, [1e-3] * 3, np.zeros(60)])
    values, vectors = whitening.largest_pairs(lambda y: a @ y, 90, 32)
    assert np.allclose(values, np.r_[[5.0] * 7, [2.0] * 20, [1e-3] * 3, [0, 0]], rtol=0, atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-11


def test_minres_solves():
    rng = np.random.default_rng(2)
    a, _ = spectrum(rng, 12, rng.normal(size=12))
    right = np.c_[rng.normal(size=(12, 3)), np.zeros(12)]
    assert np.allclose(a @ whitening._minres(lambda y: a @ y, right, 12), right, atol=1e-8)


def check(got, rows, most):
    """``got`` against exact sums and a dense covariance of ``rows``, all of one dimension."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    mean = [s / n for s in sums]
    c = np.array([[(n * e - s) / n for e, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > 1e-11 * values[0]).sum())
    assert len(got) == n * k and sum(values) > 0 and len(mean) == dim
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    for (i, _), v, centred in zip(rows, x, c):
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        exact = sum((n * e - s) ** 2 for e, s in zip(v, sums))
        assert {r.deviation for r in mine} == {exact if exact < 1 << 63 else None} and {r.n for r in mine} == {n}
        assert np.allclose([r.explained for r in mine], values[:k] / values.sum(), rtol=1e-6)
        assert max(r.identity_error for r in mine) < 1e-6
    z = np.array([[r.whitened for r in sorted(by_id[i], key=lambda r: r.component)] for i, _ in rows])
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-6
    for j in range(k):  # either sign
        want = c @ vectors[:, j] / np.sqrt(values[j])
        if np.min(np.abs(np.delete(values, j) - values[j])) > 1e-3 * values[0]:
            assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) < 1e-6


def test_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=48) * np.linspace(1, 0.05, 48)).astype(np.float32).astype(float).tolist()) for i in range(300)]
    odd = [(900, None), (901, [None] * 48), (902, [float("nan")] * 48), (903, [float("inf")] + [0.0] * 47), (904, []), (905, [1e200] * 48)]
    rows += [(906, [0.0] * 48)]
    got = run(spark, rows + odd)
    check(got, rows, 32)


def test_repeats_ranks_and_dimensions(spark):
    flat = [(i, [i % 7 * 0.5, 1.0, -(i % 7) * 0.5]) for i in range(40)]  # one direction only
    other = [(100 + i, [float(i), float(i * i % 11)]) for i in range(20)]
    got = run(spark, flat + other)
    check([r for r in got if r.vec_id < 100], flat, 32)
    check([r for r in got if r.vec_id >= 100], other, 32)
    two = run(spark, [(None, [1.0, 2.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0])], 1)
    assert sorted((str(r.vec_id), r.component, r.n) for r in two) == [("5", 1, 3), ("5", 1, 3), ("None", 1, 3)]


def test_large_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 1e9).tolist()) for i in range(30)]  # squares leave a long
    check(run(spark, rows), rows, 32)


def test_nothing_to_whiten(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
