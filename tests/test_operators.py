import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import values as V
from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import matching as M
from quern.operators import ml as L
from quern.operators import stats as S
from quern.operators import upsert as U
from quern.operators import vectors as X
from quern.operators import windows as W

T0 = datetime(2024, 1, 10)


@pytest.mark.parametrize(("bounds", "want"), [("()", {2, 3}), ("[)", {1, 2, 3}), ("[]", {1, 2, 3, 4}), ("(]", {2, 3, 4})])
@pytest.mark.parametrize("bucket", [None, 3600])
def test_interval_edges(spark, bounds, want, bucket):
    a, b, tick = T0, T0 + timedelta(hours=5), timedelta(microseconds=1)
    pts = spark.createDataFrame([(0, "x", a - tick), (1, "x", a), (2, "x", a + tick), (3, "x", b - tick), (4, "x", b), (5, "x", b + tick), (6, "x", None), (7, "y", a + tick), (8, None, a + tick)], "i int, k string, t timestamp")
    spans = spark.createDataFrame([(1, "x", a, b), (2, "x", None, b), (3, "z", a, b)], "s int, k string, a timestamp, b timestamp")
    assert {r["i"] for r in J.interval_join(pts, spans, "k", "t", "a", "b", bounds, bucket).collect()} == want
    left = J.interval_join(pts, spans, "k", "t", "a", "b", bounds, bucket, "left").collect()
    assert {r["s"] for r in left} == {1, 2, 3} and sum(r["i"] is None for r in left) == 2


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda: T0 + timedelta(days=rng.randrange(400))
    hist = [(rng.choice("abc"), day(), i, float(i)) for i in range(80)] + [("a", None, 90, 1.0), (None, T0, 91, 1.0)]
    tgt = [(i, rng.choice("abcd"), day()) for i in range(120)] + [(200, None, T0), (201, "a", None)]
    h = spark.createDataFrame(hist, "k string, ht timestamp, o int, v double")
    t = spark.createDataFrame(tgt, "i int, k string, t timestamp")
    for fallback in (False, True):
        got = {r["i"]: (r["v"], r["asof_side"]) for r in J.asof_join(t, h, "k", "t", "ht", ["v"], fallback, "o", bucket_days=30).collect()}
        for i, k, at in tgt:
            mine = [x for x in hist if k and at and x[0] == k and x[1]]
            before = [x for x in mine if x[1] <= at]
            best = (max(before, key=lambda x: (x[1], x[2]))[3], "before") if before else (min(mine, key=lambda x: (x[1], x[2]))[3], "after") if mine and fallback else (None, None)
            assert got[i] == best, (i, k, at)
    assert J.asof_join(t, h.limit(0), "k", "t", "ht", ["v"]).count() == len(tgt)


def test_inheritance(spark):
    h = timedelta(hours=1)
    replies = spark.createDataFrame([("r1", "p1", T0 + 71 * h, False), ("r2", "p1", T0 + 73 * h, False), ("r3", "p1", None, False), ("r4", "p1", T0, True), ("r5", "p2", T0, True), ("r6", "r1", T0, False), ("p1", None, T0, False), ("p2", "p1", T0, False)], "k string, p string, at timestamp, short boolean")
    own = spark.createDataFrame([("p1", T0, "issuer", "I"), ("p2", T0, "offering", "O"), ("p2", T0, "issuer", "I")], "k string, at timestamp, level string, issuer string")
    got = {(r["k"], r["issuer"]) for r in J.inherit_from_parent(replies, own, "k", "p", "at", "short").collect()}
    assert got == {("r1", "I"), ("r3", "I"), ("r5", "O"), ("r5", "I")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, v int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, s string, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(U.upsert_coalesce(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert rows(U.insert_ignore(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    assert rows(U.replace_by_key(old, new, ["k"])) == [(1, "a", 1), (2, None, 5), (3, "c", None)]
    assert rows(U.keyed_update(old, new, ["k"], ["s", "v"])) == [(1, "a", 1), (2, "b", 5)]
    assert rows(U.not_done(old, new, ["k"])) == [(1, "a", 1)]


def test_greedy_batches(spark):
    rng = random.Random(3)
    items = [(g, i, rng.randrange(1, 90)) for g in range(5) for i in range(40)] + [(9, 0, 500)]
    got = {(r["g"], r["i"]): r["batch"] for r in W.greedy_batches(spark.createDataFrame(items, "g int, i int, s int"), "g", "i", "s", 4, 120).collect()}
    for g in {x[0] for x in items}:
        b = n = size = 0
        for _, i, s in sorted(x for x in items if x[0] == g):
            if n and (n == 4 or size + s > 120):
                b, n, size = b + 1, 0, 0
            n, size = n + 1, size + s
            assert got[g, i] == b


def test_longest_match_against_brute_force(spark):
    aliases = [("A", "альфа бета гамма", "low"), ("B", "альфа бета", None), ("C", "бета", "low"), ("D", "дом", "high"), ("E", "ок1", "high"), ("F", "гамма дельта", "medium"), ("G", "", "low"), (None, "x", "low")]
    texts = ["Альфа бета гамма дельта", "бета дом ок1 гамма  дельта", "альфа, бета! бета", "", None, "альфа бета " * 3000]
    al = spark.createDataFrame([(i, a, "t", r) for i, a, r in aliases], "issuer string, alias string, alias_type string, risk_flag string")
    tx = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in M.match_aliases(tx, "k", "t", al).collect():
        got.setdefault(r["k"], set()).add((r["first"], r["gram"]))
    grams = {"альфа бета гамма", "альфа бета", "бета", "ок1", "гамма дельта"}
    import re

    for k, t in enumerate(texts):
        w, used, want = re.findall(r"[a-zа-я0-9]+", (t or "").lower()), set(), set()
        for n in range(5, 0, -1):
            for i in range(len(w) - n + 1):
                if " ".join(w[i : i + n]) in grams and not used & set(range(i, i + n)):
                    used |= set(range(i, i + n))
                    want.add((i, " ".join(w[i : i + n])))
        assert got.get(k, set()) == want
    assert M.match_aliases(tx.limit(0), "k", "t", al).count() == 0


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 400
    x, z, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 12, n)
    y = 1 + 2 * x - z + rng.normal(size=n) * (1 + abs(x))
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, x, z, g)], "y double, x double, z double, g int")
    m = np.c_[np.ones(n), x, z]
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    e, h = y - m @ b, np.einsum("ij,jk,ik->i", m, inv, m)
    for cov, meat in (("HC1", (m * e[:, None] ** 2).T @ m * n / (n - 3)), ("HC3", (m * (e / (1 - h))[:, None] ** 2).T @ m)):
        f = S.ols(df, "y", ["x", "z"], cov=cov)
        np.testing.assert_allclose(f.beta, b, rtol=1e-8)
        np.testing.assert_allclose(f.cov, inv @ meat @ inv, rtol=1e-6)
    f = S.ols(df, "y", ["x", "z"], cov="cluster", cluster="g")
    s = np.array([(m * e[:, None])[g == k].sum(axis=0) for k in np.unique(g)])
    k = len(s)
    np.testing.assert_allclose(f.cov, inv @ s.T @ s @ inv * k / (k - 1) * (n - 1) / (n - 3), rtol=1e-6)
    f = S.ols(df, "y", ["x", "z"], cov="nonrobust")
    cook = e**2 / (3 * (e @ e) / (n - 3)) * h / (1 - h) ** 2
    np.testing.assert_allclose(sorted(r["cook"] for r in f.cooks().collect()), sorted(cook), rtol=1e-6)
    aux = inv @ m.T @ e**2
    r2 = 1 - ((e**2 - m @ aux) ** 2).sum() / ((e**2 - (e**2).mean()) ** 2).sum()
    assert f.breusch_pagan()[0] == pytest.approx(n * r2, rel=1e-6)
    fit = m @ b
    big = np.c_[m, fit**2, fit**3]
    ssr = ((y - big @ np.linalg.lstsq(big, y, rcond=None)[0]) ** 2).sum()
    assert f.reset()[0] == pytest.approx((e @ e - ssr) / 2 / (ssr / (n - 5)), rel=1e-5)
    assert dict(S.vif(df, ["x", "z"]))["x"] == pytest.approx(1 / (1 - np.corrcoef(x, z)[0, 1] ** 2), rel=1e-9)


def test_logit_and_distributions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + x)))).astype(float)
    f = S.Logit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)], "y double, x double"), "y", ["x"])
    p = 1 / (1 + np.exp(-(f.beta[0] + f.beta[1] * x)))
    np.testing.assert_allclose([(y - p).sum(), ((y - p) * x).sum()], 0, atol=1e-6)
    assert f.positive and f.marginal_effect("x")[0] == pytest.approx(f.beta[1] * (p * (1 - p)).mean(), rel=1e-6)
    assert S.t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4) and S.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert S.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-7) and S.normal_cdf(0) == 0.5


def test_functions(spark):
    df = spark.createDataFrame([("ставка 7.5-8,25 % или 9-10", "1 234,50", '```json\n[{"a":1}]\n```', "c 01.02.2024 (9:30) по 03.02.2024"), ("2018-2019", "x", "none", "05.06.2023"), (None, None, None, None)], "r string, n string, j string, b string")
    rows = df.select(V.range_upper(F.col("r")).alias("u"), V.number(F.col("n")).alias("n"), V.json_part(F.col("j")).alias("j"), V.book_period(F.col("b")).alias("b")).collect()
    assert [r["u"] for r in rows] == [8.25, None, None] and [r["n"] for r in rows] == [1234.5, None, None] and [r["j"] for r in rows] == ['[{"a":1}]', None, None]
    assert rows[0]["b"]["first"] == datetime(2024, 2, 1, 9, 30) and rows[0]["b"]["last"] == datetime(2024, 2, 3) and rows[1]["b"]["last"] == datetime(2023, 6, 5)
    t = spark.createDataFrame([("Ёлка — «ОФЗ 26.2»!",), ("ок",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(T.normalize_match_text(F.col("t"))).collect()] == ["елка - офз 26.2", "ок", "", ""]
    assert [r[0] for r in t.select(T.says_little(F.col("t"))).collect()] == [False, True, True, True]
    html = spark.createDataFrame([("<p>a&nbsp;&amp;<b>b</b></p><script>x</script>",)], "h string")
    assert html.select(T.strip_html(F.col("h"))).first()[0] == "a & b"
    y = spark.createDataFrame([(0,), (-4,), (1900,), (2000,)], "y int")
    assert [tuple(r) for r in y.select(V.leap_year(F.col("y")), V.era(F.col("y")), V.century(F.col("y"))).collect()] == [(True, "BC", 1), (True, "BC", 1), (False, "AD", 19), (True, "AD", 20)]


def test_metrics_edges(spark):
    e = spark.createDataFrame([], "p double, y int")
    assert L.auc(e, "p", "y").first()["auc"] is None
    one = spark.createDataFrame([(True, "positive", 1.0, 0.0)], "r boolean, s string, v double, w double")
    m = one.agg(*A.sentiment_metrics(F.col("r"), F.col("s"), F.col("v"), F.col("w"))).first()
    assert m["std_score"] is None and m["weighted_score"] is None and m["si"] == 1.0 and m["ndi"] == 1.0
    none = one.where("false").agg(*A.sentiment_metrics(F.col("r"), F.col("s"), F.col("v"), F.col("w"))).first()
    assert none["n_all"] == 0 and none["si"] is None and none["log_buzz_all"] == 0
    two = A.profile_numeric(spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]).first()
    assert two["skew"] is None and two["kurtosis"] is None and two["median"] == 1.5


def test_split_and_nearest(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "i int, l string")
    s = {(r["l"], r["part"]): r["count"] for r in W.stratified_split(rows, ["i"], "l", 0.2, 1).groupBy("l", "part").count().collect()}
    assert s == {("a", "test"): 40, ("a", "train"): 160, ("b", "test"): 20, ("b", "train"): 80}
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], i % 2) for i in range(30)], "k int, v array<double>, l int")
    got = [r["k"] for r in X.nearest(v.where("k = 3"), v, "k", "v", 5).orderBy("place").collect()]
    assert got == sorted((i for i in range(30) if i != 3), key=lambda i: -math.cos(i - 3))[:5]


def test_packing_and_factors(spark):
    from quern.operators.packing import pack

    assert pack([5, 4, 3, 2, 9], 7) == [1, 2, 2, 1, 0] and pack([], 7) == []
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 3))
    m[:, 2] += m[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double")
    r = np.corrcoef(m.T)
    got = S.factor_adequacy(df, ["a", "b", "c"])
    assert got["bartlett"] == pytest.approx(-(299 - 11 / 6) * np.log(np.linalg.det(r)), rel=1e-9) and 0 < got["kmo"] < 1 and got["p"] < 1e-6
    np.testing.assert_allclose([s for _, s, _ in S.principal_components(df, ["a", "b", "c"])], np.linalg.eigvalsh(r)[::-1] / 3, rtol=1e-9)


def test_substring_match(spark):
    a = spark.createDataFrame([("Alpha Beta",), ("x",), (None,), ("gamma",)], "a string")
    b = spark.createDataFrame([("ao alpha beta ltd",), ("alpha",), ("",), (None,), ("delta",)], "b string")
    assert {tuple(r) for r in J.substring_match(a, b, "a", "b").collect()} == {("Alpha Beta", "ao alpha beta ltd"), ("Alpha Beta", "alpha")}
