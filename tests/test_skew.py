import random

import pandas as pd
from pyspark.sql import functions as F

from quern.operators.skew import frequent_keys, heavy_keys, salted_aggregate


def test_against_pandas(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(300)}", rng.choice([None, *range(50)]), rng.randrange(9)) for _ in range(5000)] + [(None, 1, 1), ("only null", None, 2)] * 2
    df = spark.createDataFrame(rows, "k string, v long, __salt long")
    assert heavy_keys(df, "k", 0.05) == ["hot"]
    out = salted_aggregate(df, "k", sums={"s": F.col("v")}, minima={"lo": F.col("v")}, maxima={"hi": F.col("v")}, distinct={"d": F.col("v"), "e": F.col("__salt")}).toPandas().set_index("k")
    p = pd.DataFrame(rows, columns=["k", "v", "w"]).dropna(subset=["k"])
    want = p.groupby("k").agg(n=("w", "size"), s=("v", lambda x: x.sum(min_count=1)), lo=("v", "min"), hi=("v", "max"), d=("v", "nunique"), e=("w", "nunique"))
    assert set(out.index) == set(want.index)
    for c in want:
        pd.testing.assert_series_equal(out[c].sort_index().astype(float), want[c].sort_index().astype(float), check_names=False)


def test_shares_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 2 + [(None,)] * 94, "k string")
    assert [tuple(r) for r in frequent_keys(df, "k", 0.04).collect()] == [("a", 4)]
    assert frequent_keys(df.limit(0), "k", 0.04).count() == 0
    assert salted_aggregate(df.limit(0), "k").count() == 0


def test_result_named_as_the_key(spark):
    import pytest

    with pytest.raises(ValueError):
        salted_aggregate(spark.createDataFrame([("a",)], "n string"), "n")
