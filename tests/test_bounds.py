"""Bounds of broadcasts and folders, exact percentiles, matches of short and cut words, blocks of queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import scale
from quern.functions import text as T
from quern.functions import values as V
from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import ml as L
from quern.operators import vectors as X
from quern.streaming.ingest import upsert_sink


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, ["y" * 50]) for i in range(20)], "a int, b string, c array<string>")
    assert hinted(scale.checked_broadcast(df)) and not hinted(scale.checked_broadcast(df, max_rows=19)) and not hinted(scale.checked_broadcast(df, max_bytes=2000))
    assert hinted(scale.checked_broadcast(df, max_bytes=5000)) and hinted(scale.checked_broadcast(df.limit(0)))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        scale.shared_dir(Session())


def test_an_unreadable_version_is_an_error(spark, tmp_path):
    write = upsert_sink(str(tmp_path / "t"), ["id"], lambda old, new, keys: old.unionByName(new))
    df = spark.createDataFrame([(1,)], "id int")
    write(df, 0)
    write(df, 1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        write(df, 5)
    assert spark.read.parquet(str(tmp_path / "t/v=1")).count() == 2


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy tail", "one"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=3001), "ties": rng.integers(0, 4, 1000).astype(float), "heavy tail": np.exp(6 * rng.normal(size=2000)), "one": np.array([7.0])}[kind]
    df = spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, None)], "x double, y double").repartition(3)
    ps = [0.0, 0.01, 0.5, 0.613, 0.99, 1.0]
    got = {r["variable"]: r["q"] for r in A.exact_percentiles(df, ["x", "y"], ps).collect()}
    np.testing.assert_allclose(got["x"], np.quantile(x, ps), rtol=1e-12)
    assert got["y"] == [1.0] * len(ps)
    assert A.exact_percentiles(df.limit(0), ["x"], ps).count() == 0


def test_short_beginnings_match(spark):
    q = spark.createDataFrame([("a",), ("ab",), ("abcdef",), ("zz",), ("",), (None,)], "q string")
    i = spark.createDataFrame([("abc",), ("AB",), ("b",), ("",), (None,)], "i string")
    got = {r["q"]: (r["match"], r["match_rank"]) for r in J.best_match(q, i, "q", "i").collect()}
    assert got == {"a": ("AB", 1), "ab": ("AB", 0), "abcdef": ("AB", 2), "zz": (None, None), "": (None, None), None: (None, None)}


def test_substrings_within_words(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(60)]
    a, b = words[:30], words[30:]
    da, db = spark.createDataFrame([(w,) for w in a], "a string"), spark.createDataFrame([(w,) for w in b], "b string")
    assert {tuple(r) for r in J.substring_match(da, db, "a", "b").collect()} == {(x, y) for x in a for y in b if x in y or y in x}


def test_labels(spark):
    rows = [(1.0, 0.01, "positive"), (-1.0, 0.01, "positive"), (-1.0, 0.01, "negative"), (1.0, 0.5, "positive"), (1.0, 0.01, "either"), (None, 0.01, "positive"), (1.0, None, "")]
    df = spark.createDataFrame(rows, "c double, p double, e string")
    got = [r[0] for r in df.select(V.evidence(F.col("c"), F.col("p"), F.col("e"))).collect()]
    assert got == ["supports", "opposite sign", "supports", "no evidence", "significant", "not estimated", "not estimated"]
    df = spark.createDataFrame([("ok",), (" TP ",), ("wrong",), ("fp",), (None,)], "x string")
    assert [r[0] for r in df.select(V.label01(F.col("x"))).collect()] == [None, 1, None, 0, None]
    df = spark.createDataFrame([("RT @a: A naïve #x word&more a@b.c www.q.w 12!",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.clean_post(F.col("x"))).collect()] == ["a nave word more", "", None]
    df = spark.createDataFrame([("12345.0",), ("12345678901",), (None,)], "x string")
    assert [r[0] for r in df.select(V.padded_id(F.col("x"))).collect()] == ["0000012345", "12345678901", None]


def test_queries_come_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "k int, v array<double>")
    q = df.where("k % 3 = 0")
    want = sorted(map(tuple, X.nearest(q, df.where("k < 99"), "k", "v", 3).collect()))
    assert sorted(map(tuple, X.nearest(q, df.where("k < 99"), "k", "v", 3, block=6).collect())) == want and len(want) >= 60


def test_lines_and_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=120)
    df = spark.createDataFrame([(*map(float, r), float(t), i % 6) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, y double, f int")
    got = dict(L.ridge(df, ["a", "b"], "y", 5.0))
    c = x - x.mean(0)
    b = np.linalg.solve(c.T @ c + 5 * np.eye(2), c.T @ (y - y.mean()))
    assert [got["a"], got["b"], got["const"]] == pytest.approx([*b, y.mean() - b @ x.mean(0)])
    for r in L.line_folds(df, "a", "y", "f").collect():
        test = np.arange(120) % 6 == r["f"]
        p = np.polyfit(x[~test, 0], y[~test], 1)
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean((np.polyval(p, x[test, 0]) - y[test]) ** 2)))


def test_winner_needs_a_lead(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.7), ("b", "x", 0.9), ("b", "y", 0.85), ("c", "z", 0.1)], "k string, i string, s double")
    assert {(r["k"], r["i"]) for r in J.ranked_winner(df, "k", "s").collect()} == {("a", "x"), ("c", "z")}


def test_factors_and_linkage(spark):
    from quern.operators import stats as S

    rng = np.random.default_rng(4)
    w, h = rng.uniform(size=(200, 2)), rng.uniform(size=(2, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in w @ h] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, e double")
    errors = [S.non_negative_factors(df, df.columns, k)[1] for k in (1, 2)]
    assert errors[1] < 0.2 * errors[0] and (S.non_negative_factors(df, df.columns, 2)[0] >= 0).all()
    pts = [(i, float(c * 10 + rng.normal() * 0.1), float(c)) for i, c in enumerate([0, 1, 0, 2, 1, 2, 2])]
    got = L.complete_linkage(spark.createDataFrame([*pts, (99, None, 1.0)], "k int, x double, y double"), "k", ["x", "y"], 3)
    assert got == [(0, 0), (1, 1), (2, 0), (3, 2), (4, 1), (5, 2), (6, 2)]
    with pytest.raises(ValueError, match="most"):
        L.complete_linkage(df, "a", ["b"], 2, most=10)


def test_next_day_of_a_calendar(spark):
    import datetime as dt

    cal = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 8, 9, 15, 9)] + [(None,)], "day date")
    D = lambda d, h=0: dt.datetime(2024, 1, d, h)
    ev = [(1, D(1)), (2, D(5)), (3, D(5, 1)), (4, D(9, 23)), (5, D(15)), (6, D(15, 1)), (7, None), (8, D(8)), (8, D(8))]
    want = {1: 5, 2: 5, 3: 8, 4: 15, 5: 15, 6: None, 7: None, 8: 8}
    for kind in ("timestamp_ntz", "date"):
        df = spark.createDataFrame(ev, "k int, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
        rows = J.next_in_calendar(df, cal, "t", "day").collect()
        exact = want if kind != "date" else want | {3: 5, 4: 9, 6: 15}
        assert len(rows) == 9 and {r["k"]: r["next_day"] and r["next_day"].day for r in rows} == exact
    assert {r["next_day"] for r in J.next_in_calendar(df, cal.limit(0), "t", "day").collect()} == {None}
