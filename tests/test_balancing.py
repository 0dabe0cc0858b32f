from collections import Counter

import numpy as np
import pytest

from quern.operators import ml as L


@pytest.mark.parametrize("block", [1024, 7])
def test_small_classes_reach_the_share(spark, block):
    rng = np.random.default_rng(5)
    near = lambda n, spread: rng.normal(size=8) + spread * rng.normal(size=(n, 8))
    vectors = {"big": rng.normal(size=(200, 8)), "few": near(10, 0.4), "rare": np.r_[np.eye(64)[:, :8][:8], -np.eye(8), [[1, 0.9] + [0] * 6]], "none": np.eye(8), "zero": np.zeros((3, 8))}
    rows = [(f"{c}{i}", v.tolist(), c) for c, x in vectors.items() for i, v in enumerate(x)] + [("null", None, "few"), (None, [1.0] * 8, "few")]
    df = spark.createDataFrame(rows, "id string, v array<double>, label string").repartition(3)
    got = L.balance_by_mixing(df, "id", "v", "label", block=block).collect()
    assert Counter(r["label"] for r in got) == {"few": 180 - 12, "rare": 180 - 17}
    of = {r[0]: np.array(r[1]) for r in rows if r[0] and r[1]}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in got:
        a, b = of[r["a"]], of[r["b"]]
        assert r["a"] != r["b"] and 0.65 <= cos(a, b) < 0.99 and 0.35 <= r["alpha"] < 0.65
        mix = r["alpha"] * a + (1 - r["alpha"]) * b
        assert np.allclose(r["vector"], mix / np.abs(mix).sum())
    x = vectors["few"]
    valid = {frozenset((f"few{i}", f"few{j}")) for i in range(10) for j in range(i) if 0.65 <= cos(x[i], x[j]) < 0.99}
    drawn = {frozenset((r["a"], r["b"])) for r in got if r["label"] == "few"}
    assert drawn <= valid and len(drawn) > 0.8 * len(valid)
    assert len({r["alpha"] for r in got if r["label"] == "rare"}) > 100
