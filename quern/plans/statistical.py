"""Event studies, regressions, diagnostics and scores on the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import ml as L
from quern.operators import mle as E
from quern.operators import stats as S
from quern.operators.windows import year_folds
from quern.sources.tables import table


def _returns(spark, d):
    """Daily mean price of supplier and of all, as stand-ins for returns and market."""
    l = table(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice").withColumn("day", F.to_date("l_shipdate"))
    r = l.groupBy(F.col("l_suppkey").alias("security"), "day").agg(F.avg("l_extendedprice").alias("r"))
    return r, l.groupBy("day").agg(F.avg("l_extendedprice").alias("rm"))


def _events(spark, d):
    r, _ = _returns(spark, d)
    w = Window.partitionBy("security").orderBy("day")
    return r.withColumn("i", F.row_number().over(w)).where("i = 300").select("security", F.col("day").alias("event_day"))


def market_model_car(spark, d):
    out = S.market_model(*_returns(spark, d), _events(spark, d))
    return out.select("security", "event_day", F.col("t").cast("bigint").alias("t"), F.round("ar", 4).alias("ar"), F.round("car", 4).alias("car"))


def caar_by_event_day(spark, d):
    out = S.average_car(S.market_model(*_returns(spark, d), _events(spark, d)))
    return out.select(F.col("t").cast("bigint").alias("t"), "events", F.round("aar", 4).alias("aar"), F.round("t_stat", 4).alias("t_stat"))


def _table(spark, rows, *names):
    return spark.createDataFrame([tuple(x if isinstance(x, str) else float(x) for x in r) for r in rows], ", ".join(f"{n} {'string' if n == 'term' else 'double'}" for n in names))


def _orders(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), (F.col("c_acctbal") / 1000).alias("balance"), F.year("o_orderdate").cast("double").alias("year"), "c_mktsegment", F.col("c_nationkey").alias("nation"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))


def ols_simple(spark, d):
    """Slope, intercept and R² of price on balance, checked against closed-form SQL."""
    f = S.ols(_orders(spark, d), "price", ["balance"], cov="nonrobust")
    return _table(spark, [(round(f.beta[0], 6), round(f.beta[1], 6), round(f.r2, 8), f.n)], "intercept", "slope", "r2", "n")


def ols_robust(spark, d):
    f = S.ols(_orders(spark, d), "price", ["balance", "year"], ["c_mktsegment"], "HC3")
    return _table(spark, f.table(), "term", "estimate", "se", "t", "p")


def ols_cluster(spark, d):
    f = S.ols(_orders(spark, d), "price", ["balance", "year"], ["c_mktsegment"], "cluster", "nation")
    return _table(spark, f.table(), "term", "estimate", "se", "t", "p")


def diagnostics(spark, d):
    o = _orders(spark, d)
    f = S.ols(o, "price", ["balance", "year"], cov="nonrobust")
    bp, jb, rs = f.breusch_pagan(), f.jarque_bera(), f.reset()
    rows = [("breusch_pagan", *bp), ("jarque_bera", *jb), ("reset", *rs), ("condition_number", f.condition_number(), float("nan"))] + [(f"vif_{x}", v, float("nan")) for x, v in S.vif(o, ["balance", "year"])]
    return _table(spark, rows, "term", "statistic", "p")


def cooks_distance(spark, d):
    """Rows whose Cook's distance exceeds 4/n, with leverage."""
    f = S.ols(_orders(spark, d), "price", ["balance"], cov="nonrobust")
    return f.cooks().where(F.col("cook") > 4 / f.n).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("h"), 6).alias("leverage"))


def durbin_watson(spark, d):
    """Of prices less their mean in order of the key."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    m = o.agg(F.avg("o_totalprice").alias("m"))
    r = o.crossJoin(F.broadcast(m)).withColumn("e", F.col("o_totalprice") - F.col("m"))
    return S.durbin_watson(r, "e", "o_orderkey").select(F.round("dw", 6).alias("dw"))


def logit_urgent(spark, d):
    f = S.Logit(_orders(spark, d), "urgent", ["balance", "price"])
    ame = f.marginal_effect("price")
    return _table(spark, [(n, b, s) for n, b, s in zip(f.names, f.beta, f.se)] + [("ame_price", *ame)], "term", "estimate", "se")


def bootstrap_mean(spark, d):
    b = S.bootstrap_means(table(spark, d, "events", "event_id", "value"), ["event_id"], "value", 999)
    return b.agg(F.count(F.lit(1)).alias("draws"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def _scored(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "value")
    return e.select((F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"))


def auc_ranksum(spark, d):
    return L.auc(_scored(spark, d), "p", "y").select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


def confusion_metrics(spark, d):
    s = _scored(spark, d)
    m = L.binary_metrics(s, (F.col("p") >= 0.2).cast("int"), F.col("y"), F.col("p"))
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("brier", "accuracy", "precision", "recall", "f1", "balanced_accuracy")])


def threshold_tuning(spark, d):
    return L.best_threshold(_scored(spark, d), "p", "y").select(F.round("threshold", 4).alias("threshold"), F.round("f1", 6).alias("f1"))


def neutral_zone(spark, d):
    e = table(spark, d, "events", "event_id", "value")
    total = F.col("value") + 60
    label = L.neutral_zone(F.lit(20) / total, F.lit(40) / total, F.col("value") / total, 0.45, 0.1)
    return e.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_weights(spark, d):
    return L.class_weights(table(spark, d, "eval_items", "sentiment"), "sentiment", 0.5).select("sentiment", "n", F.round("weight", 6).alias("weight"))


def macro_scores(spark, d):
    docs = table(spark, d, "documents", "lang", "text").where("lang in ('ru', 'en', 'uk')")
    guess = F.when(F.col("text").rlike("[іїє]"), "uk").when(F.col("text").rlike("[а-я]"), "ru").otherwise("en")
    return L.macro_f1(docs.withColumn("guess", guess), "guess", "lang").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


def temporal_scaling(spark, d):
    """Prices standardised by the training rows of each fold."""
    o = _orders(spark, d).withColumn("year", F.col("year").cast("bigint"))
    f = L.scale_by_train(year_folds(o.select("price", "year"), "year", 1999, 2001), ["price"], by=["test_year"])
    return f.groupBy(F.col("test_year").cast("bigint").alias("test_year"), "part").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("price"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("price"), 6).alias("std"))


def class_balancing(spark, d):
    """Mixtures made by class; none where a class has no pair of a similarity in [0.65, 0.99)."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return L.balance_by_mixing(v, "vec_id", "embedding", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def tobit_price(spark, d):
    """Prices above 100 on balance, censored from below."""
    o = _orders(spark, d).withColumn("over", F.greatest(F.col("price") - 100, F.lit(0.0)) / 100)
    t = E.tobit(o, "over", ["balance"])
    return _table(spark, zip(t.names, t.theta, t.se), "term", "estimate", "se")


def biprobit_flags(spark, d):
    """Urgency and a high price as two probits with correlated errors."""
    o = _orders(spark, d).withColumn("high", (F.col("price") > 150).cast("double")).withColumn("year0", F.col("year") - 1998)
    t = E.biprobit(o, "urgent", "high", ["balance"], ["year0"])
    return _table(spark, zip(t.names, t.theta, t.se), "term", "estimate", "se")


def auc_bootstrap(spark, d):
    """Interval of the difference of two scores' AUC over paired draws."""
    e = table(spark, d, "events", "event_id", "event_type", "value")
    rows = e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), (F.pmod(F.col("event_id"), F.lit(97)) / 97).alias("q"))
    b = E.bootstrap_auc(rows, ["p", "q"], "y", ["event_id"])
    d_ = F.col("p") - F.col("q")
    return b.agg(F.count(F.lit(1)).alias("draws"), F.percentile("p", F.lit(0.025)).alias("low"), F.percentile("p", F.lit(0.975)).alias("high"), F.percentile(d_, F.lit(0.025)).alias("delta_low"), F.percentile(d_, F.lit(0.975)).alias("delta_high"))


def line_robust(spark, d):
    """Slope of a line with its standard errors: plain, robust (HC1, HC3) and by clusters of nations."""
    o = _orders(spark, d)
    rows = []
    for kind in ("nonrobust", "HC1", "HC3", "cluster"):
        f = S.ols(o, "price", ["balance"], cov=kind, cluster="nation" if kind == "cluster" else None)
        i = f.names.index("balance")
        rows.append((kind, float(f.beta[i]), float(f.se[i])))
    return _table(spark, rows, "term", "slope", "se").select("term", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def line_diagnostics(spark, d):
    """Breusch-Pagan and Jarque-Bera statistics of a line, and variance inflation of two regressors."""
    o = _orders(spark, d)
    f = S.ols(o, "price", ["balance"], cov="nonrobust")
    rows = [("breusch_pagan", f.breusch_pagan()[0]), ("jarque_bera", f.jarque_bera()[0]), ("vif", S.vif(o, ["balance", "year"])[0][1])]
    return _table(spark, rows, "term", "statistic").select("term", F.round("statistic", 5).alias("statistic"))


def logit_share(spark, d):
    """A logit with one binary regressor: its coefficients are the log odds of the two groups, its average marginal effect the difference of shares by the derivative."""
    o = _orders(spark, d).withColumn("rich", (F.col("balance") > 5).cast("double"))
    f = S.Logit(o, "urgent", ["rich"])
    return _table(spark, [(n, float(b)) for n, b in zip(f.names, f.beta)], "term", "estimate").select("term", F.round("estimate", 6).alias("estimate"))


def auc_steps(spark, d):
    """AUC of growing sets of features on a later year, and what each set adds."""
    return _table(spark, L.auc_steps(_orders(spark, d), [["year"], ["balance"], ["price"]], "urgent", "year", 2000), "term", "auc", "gain")


def factor_parts(spark, d):
    """Error of non-negative factorisations of one and two factors."""
    l = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax").select(*[(F.col(c) / m).alias(c) for c, m in (("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.08))])
    return _table(spark, [(f"error_{k}", S.non_negative_factors(l, l.columns, k, 12)[1]) for k in (1, 2)], "term", "value")


def linked_groups(spark, d):
    """Customers' segments by nation grouped by complete linkage: size of the three groups."""
    n = table(spark, d, "customer", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s")).na.fill(0.0)
    g = L.complete_linkage(n, "c_nationkey", ["m", "s"], 3)
    return _table(spark, [(str(k), float(v)) for k, v in g], "term", "group")


_NAMES = "line_robust line_diagnostics logit_share auc_steps factor_parts linked_groups tobit_price biprobit_flags auc_bootstrap market_model_car caar_by_event_day ols_simple ols_robust ols_cluster diagnostics cooks_distance durbin_watson logit_urgent bootstrap_mean auc_ranksum confusion_metrics threshold_tuning neutral_zone label_weights macro_scores temporal_scaling class_balancing"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_MM = """l AS (SELECT l_suppkey AS security, l_shipdate::DATE AS d0, l_extendedprice p FROM lineitem), r AS (SELECT security, d0, avg(p) r FROM l GROUP BY ALL), m AS (SELECT d0, avg(p) rm FROM l GROUP BY d0),
    x AS (SELECT r.*, m.rm, row_number() OVER (PARTITION BY security ORDER BY r.d0) i FROM r JOIN m USING (d0)), e AS (SELECT security, d0 AS event_day FROM x WHERE i = 300),
    n AS (SELECT x.*, event_day, i - 300 AS t FROM x JOIN e USING (security)), est AS (SELECT security, regr_intercept(r, rm) a, regr_slope(r, rm) b FROM n WHERE t >= -196 AND t < -16 GROUP BY 1 HAVING count(*) = 180),
    w AS (SELECT security, event_day, t, r - (a + b * rm) ar FROM n JOIN est USING (security) WHERE t BETWEEN -2 AND 2)"""
_SC = "s AS (SELECT (event_type = 'purchase')::INT y, least(value / 500, 1.0) p FROM events)"
_XY = "d AS (SELECT o_totalprice / 1000 y, c_acctbal / 1000 x, c_nationkey g, year(o_orderdate)::DOUBLE z FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT regr_intercept(y, x) a, regr_slope(y, x) b, avg(x) mx, count(*) n, var_pop(x) * count(*) sxx FROM d), e AS (SELECT y - a - b * x e, x - mx c, 1 / n + (x - mx) * (x - mx) / sxx h, g, n, sxx, b, x FROM d, f)"
ORACLE = {
    "line_robust": f"""WITH {_XY}, s AS (SELECT any_value(b) b, any_value(n) n, any_value(sxx) sxx, sum(e * e) ee, sum(c * c * e * e) w, sum(c * c * e * e / ((1 - h) * (1 - h))) w3 FROM e), k AS (SELECT sum(u * u) u, count(*) g FROM (SELECT sum(c * e) u FROM e GROUP BY g))
        SELECT 'nonrobust' term, round(b, 7) slope, round(sqrt(ee / (n - 2) / sxx), 7) se FROM s UNION ALL SELECT 'HC1', round(b, 7), round(sqrt(n / (n - 2) * w) / sxx, 7) FROM s UNION ALL SELECT 'HC3', round(b, 7), round(sqrt(w3) / sxx, 7) FROM s
        UNION ALL SELECT 'cluster', round(b, 7), round(sqrt(u * (g / (g - 1)) * ((n - 1) / (n - 2))) / sxx, 7) FROM s, k""",
    "line_diagnostics": f"""WITH {_XY}, m AS (SELECT avg(e) m FROM e), j AS (SELECT count(*) n, avg((e - m) ** 3) / avg((e - m) ** 2) ** 1.5 s, avg((e - m) ** 4) / avg((e - m) ** 2) ** 2 - 3 k FROM e, m)
        SELECT 'breusch_pagan' term, round(count(*) * regr_r2(e * e, x), 5) statistic FROM e UNION ALL SELECT 'jarque_bera', round(n / 6 * (s * s + k * k / 4), 5) FROM j UNION ALL SELECT 'vif', round(1 / (1 - corr(x, z) ** 2), 5) FROM d""",
    "logit_share": """WITH g AS (SELECT c_acctbal > 5000 r, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), o AS (SELECT max(ln(p / (1 - p))) FILTER (NOT r) a, max(ln(p / (1 - p))) FILTER (r) b FROM g)
        SELECT 'const' term, round(a, 6) estimate FROM o UNION ALL SELECT 'rich', round(b - a, 6) FROM o""",
    "market_model_car": f"WITH {_MM} SELECT security, event_day, t, round(ar, 4) ar, round(sum(ar) OVER (PARTITION BY security ORDER BY t ROWS UNBOUNDED PRECEDING), 4) car FROM w",
    "caar_by_event_day": f"WITH {_MM} SELECT t, count(*) AS events, round(avg(ar), 4) aar, round(avg(ar) / (stddev_samp(ar) / sqrt(count(*))), 4) t_stat FROM w GROUP BY t",
    "ols_simple": "SELECT round(regr_intercept(y, x), 6) intercept, round(regr_slope(y, x), 6) slope, round(regr_r2(y, x), 8) r2, count(*)::DOUBLE n FROM (SELECT o_totalprice / 1000 y, c_acctbal / 1000 x FROM orders JOIN customer ON o_custkey = c_custkey)",
    "cooks_distance": """WITH d AS (SELECT o_totalprice / 1000 y, c_acctbal / 1000 x FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT regr_intercept(y, x) a, regr_slope(y, x) b, avg(x) mx, regr_sxx(y, x) sxx, count(*) n FROM d),
        e AS (SELECT y - a - b * x e, 1 / n + (x - mx) * (x - mx) / sxx h, n FROM d, f), g AS (SELECT *, sum(e * e) OVER () / (n - 2) s2 FROM e)
        SELECT count(*) n, round(sum(h), 6) leverage FROM g WHERE e * e / (2 * s2) * h / ((1 - h) * (1 - h)) > 4 / n""",
    "durbin_watson": "WITH e AS (SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER () e FROM orders), l AS (SELECT e, e - lag(e) OVER (ORDER BY o_orderkey) d FROM e) SELECT round(sum(d * d) / sum(e * e), 6) dw FROM l",
    "auc_ranksum": f"WITH {_SC}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 k FROM s) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 9) auc, count(*) FILTER (y = 1) n_pos, count(*) FILTER (y = 0) n_neg FROM r",
    "confusion_metrics": f"""WITH {_SC}, c AS (SELECT count(*) FILTER (p >= 0.2 AND y = 1) tp, count(*) FILTER (p >= 0.2 AND y = 0) fp, count(*) FILTER (p < 0.2 AND y = 0) tn, count(*) FILTER (p < 0.2 AND y = 1) fn, avg((p - y) * (p - y)) brier FROM s)
        SELECT tp, fp, tn, fn, round(brier, 6) brier, round((tp + tn) / (tp + fp + tn + fn), 6) accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy FROM c""",
    "threshold_tuning": f"""WITH {_SC}, g AS (SELECT i / 100 t FROM range(1, 100) r(i)), f AS (SELECT t, 2.0 * count(*) FILTER (y = 1 AND round(p, 9) >= t) / (count(*) FILTER (round(p, 9) >= t) + count(*) FILTER (y = 1)) f1 FROM g, s GROUP BY t)
        SELECT round(t, 4) threshold, round(f1, 6) f1 FROM f ORDER BY round(f1, 12) DESC, abs(t - 0.5), t LIMIT 1""",
    "neutral_zone": """WITH p AS (SELECT 20 / (value + 60) a, 40 / (value + 60) b, value / (value + 60) c FROM events), l AS (SELECT *, greatest(a, b, c) m, CASE WHEN a = m THEN 'negative' WHEN b = m THEN 'neutral' WHEN c = m THEN 'positive' END l FROM p)
        SELECT CASE WHEN l <> 'neutral' AND (m < 0.45 OR m - b < 0.1) THEN 'neutral' ELSE l END AS label, count(*) n FROM l GROUP BY 1""",
    "label_weights": "WITH c AS (SELECT sentiment, count(*) n FROM eval_items WHERE sentiment IS NOT NULL GROUP BY 1), w AS (SELECT *, sqrt(sum(n) OVER () / (count(*) OVER () * n)) r FROM c) SELECT sentiment, n, round(r / avg(r) OVER (), 6) weight FROM w",
    "macro_scores": """WITH d AS (SELECT lang, CASE WHEN regexp_matches(text, '[іїє]') THEN 'uk' WHEN regexp_matches(text, '[а-я]') THEN 'ru' ELSE 'en' END g FROM documents WHERE lang IN ('ru', 'en', 'uk')), k AS (SELECT DISTINCT lang AS l FROM d),
        f AS (SELECT l, 2.0 * count(*) FILTER (lang = l AND g = l) / (count(*) FILTER (lang = l) + count(*) FILTER (g = l)) f1 FROM k, d GROUP BY l)
        SELECT round((SELECT avg(f1) FROM f), 6) macro_f1, round(avg(CASE WHEN lang = g THEN 1.0 ELSE 0.0 END), 6) accuracy FROM d""",
    "temporal_scaling": """WITH o AS (SELECT o_totalprice / 1000 p, year(o_orderdate) y FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT t, y, p, CASE WHEN y = t THEN 'test' ELSE 'train' END part FROM o, range(1999, 2002) r(t) WHERE y <= t),
        s AS (SELECT t, avg(p) m, stddev_pop(p) s FROM f WHERE part = 'train' GROUP BY t)
        SELECT t AS test_year, part, count(*) n, round(avg((p - m) / s), 6) + 0.0 AS mean, round(stddev_pop((p - m) / s), 6) std FROM f JOIN s USING (t) GROUP BY ALL""",
}
