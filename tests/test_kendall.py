"""Kendall's tau by blocks against all pairs."""

import numpy as np

from corpweave.operators import kendall as K


def brute(x, y):
    a, b = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    below = (np.abs(a).sum() * np.abs(b).sum()) ** 0.5
    return float((a * b).sum() / below) if below else None


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 200, 517):
        a = rng.integers(0, 50, n)
        assert K.inversions(a) == int(np.triu(a[:, None] > a[None], 1).sum())


def test_tau_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for x, y in ((rng.normal(size=700), rng.integers(0, 4, 700)), (rng.integers(0, 9, 500), rng.integers(0, 9, 500)), (np.arange(300), -np.arange(300)), (np.r_[np.zeros(250), np.arange(50)], rng.integers(0, 3, 300)), (np.ones(40), np.arange(40))):
            rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(10_000, None, 1.0), (10_001, float("nan"), 2.0)]
            got, want = K.tau_b(spark.createDataFrame(rows, "id long, x double, y double").repartition(3), "x", "y", "id"), brute(x.astype(float), y.astype(float))
            assert got == want is None or abs(got - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert K.tau_b(spark.createDataFrame([], "id long, x double, y double"), "x", "y", "id") is None
