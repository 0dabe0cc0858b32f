import numpy as np
import pytest

from quern.operators.mle import biprobit, bivariate_cdf, bootstrap_auc, normal_cdf, tobit


def test_bivariate_cdf():
    rng = np.random.default_rng(1)
    for a, b, r in ((0.3, -0.5, 0.6), (1.0, 1.0, -0.4), (0.0, 0.0, 0.9)):
        x = rng.normal(size=400_000)
        y = r * x + np.sqrt(1 - r * r) * rng.normal(size=400_000)
        assert bivariate_cdf([a], [b], [r])[0] == pytest.approx(((x < a) & (y < b)).mean(), abs=4e-3)
    assert bivariate_cdf([0.2], [0.1], [0.0])[0] == pytest.approx(normal_cdf(0.2) * normal_cdf(0.1))
    assert bivariate_cdf([0.0], [0.0], [0.5])[0] == pytest.approx(1 / 3)


def test_estimates(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x, z = rng.normal(size=n), rng.normal(size=n)
    e = rng.normal(size=n)
    f = 0.5 * e + np.sqrt(0.75) * rng.normal(size=n)
    y = np.maximum(0, 0.5 + x - 0.5 * z + 1.5 * e)
    a, b = (0.2 + x + e > 0).astype(float), (-0.3 + z + f > 0).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, z, y, a, b]], "x double, z double, y double, a double, b double")
    t = tobit(df, "y", ["x", "z"])
    assert np.abs((t.theta - [0.5, 1, -0.5, np.log(1.5)]) / t.se).max() < 4 and t.positive
    p = biprobit(df, "a", "b", ["x"], ["z"])
    assert np.abs((p.theta - [0.2, 1, -0.3, 1, np.arctanh(0.5)]) / p.se).max() < 4
    assert np.abs(p.gradient / n).max() < 1e-2


def test_bootstrap_auc(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    good, bad = np.clip(0.3 + 0.4 * y + 0.2 * rng.normal(size=500), 0, 1), rng.random(500)
    df = spark.createDataFrame([(i, float(g), float(b), int(v)) for i, (g, b, v) in enumerate(zip(good, bad, y))], "i int, good double, bad double, y int")
    rows = bootstrap_auc(df, ["good", "bad"], "y", ["i"], 40).collect()
    exact = np.mean([(p > q) + 0.5 * (p == q) for p in good[y == 1] for q in good[y == 0]])
    assert len(rows) == 40 and np.mean([r["good"] for r in rows]) == pytest.approx(exact, abs=0.02)
    assert all(r["good"] > r["bad"] for r in rows)
