"""The block matrix join against brute force over rows, odd vectors and ids included."""

import numpy as np
from pyspark.sql import functions as F

from knowntime.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, raw string, block int, q int"


def brute(rows, asked, k, kind=float):
    good = [(at, i, np.array(v, kind)) for at, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, i, v in good:
        if not asked(i):
            continue
        near = sorted(
            (float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0, b) for b, j, w in good if b != at and len(w) == len(v)
        )
        out += [(i, n + 1, None if none else j, d) for n, (d, none, j, _) in enumerate(near[:k])]
    return sorted(out, key=str)


def found(spark, rows, asked, k=10):
    df = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in neighbours.nearest_vectors(df, asked, k).collect()), key=str)


def same(got, want):
    assert [g[:3] for g in sorted(got, key=lambda r: (str(r[0]), r[1], str(r[2])))] == [w[:3] for w in sorted(want, key=lambda r: (str(r[0]), r[1], str(r[2])))]
    assert np.allclose(sorted(g[3] for g in got), sorted(w[3] for w in want), rtol=1e-12, atol=0)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 12))
    rows = [(i, (middle[i % 6] + rng.normal(size=12) * 10.0 ** -(i % 9)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[100][1]) for i in range(120)]  # copies, queries among them
    rows += [(600, None), (700, []), (800, [0.0] * 12), (900, [1.0, None] * 6), (1000, [float("nan")] * 12), (1100, [float("inf")] + [1.0] * 11)]
    rows += [(1200, [1.0, 2.0, 3.0]), (1201, [1.0, 2.0, 3.5]), (1202, [-1.0, 0.0, 0.0]), (1300, [2.5])]  # few or no candidates
    rows += [(None, rows[3][1]), (300, rows[4][1]), (300, rows[4][1])]  # null and repeated ids
    same(found(spark, rows, F.col("vec_id") % 100 == 0), brute(rows, lambda i: i is not None and i % 100 == 0, 10))


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(neighbours, "STRIPE_PAIRS", 500)
    rng = np.random.default_rng(6)
    rows = [(i, np.round(rng.normal(size=5), 1).tolist()) for i in range(500)]  # rounded, so distances tie
    asked = F.col("vec_id") % 5 == 0
    same(found(spark, rows, asked, 3), brute(rows, lambda i: i % 5 == 0, 3))


def test_magnitudes_and_wide_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([-170, -3, 0, 140])).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=2500).tolist()) for i in range(30)]
    same(found(spark, rows, F.col("vec_id") % 10 == 0), brute(rows, lambda i: i % 10 == 0, 10, np.longdouble))  # wider exponents


def test_heaps_in_small_tiles(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 50)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(20, 6)), np.round(rng.normal(size=(300, 6)))
    heaps = neighbours.Heaps(a, 4)
    for at in range(0, 300, 70):
        heaps.meet(b[at : at + 70], np.arange(300)[at : at + 70] % 150, np.arange(300)[at : at + 70])
    got = heaps.rows(np.arange(20)).sort_values(["q", "score", "least", "c"])
    for q in range(20):
        d = neighbours.distances(np.repeat(a[q : q + 1], 300, 0), b)
        want = np.lexsort((np.arange(300), np.arange(300) % 150, d))[:4]
        assert got[got["q"] == q]["c"].tolist() == want.tolist()


def test_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 1500)), rng.normal(size=(30, 1500)) * 3
    b[:10] = a[:10] + rng.normal(size=(10, 1500)) * 1e-6
    low, high = neighbours.bounds(neighbours.Codes(a), neighbours.Codes(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert (low <= true).all() and (true <= high).all() and (high - low).max() < 4


def test_nothing_to_find(spark):
    assert found(spark, [], F.col("vec_id") % 100 == 0) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])], F.col("vec_id") % 100 == 0) == []
    assert found(spark, [(100, [1.0])], F.col("vec_id") % 100 == 0) == []
    assert found(spark, [(100, None)], F.lit(None).cast("boolean")) == []
