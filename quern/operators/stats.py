"""Regression and its diagnostics from distributed sums; only k x k matrices reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (v if abs(v := 1 + num * d) > tiny else tiny)
            c = v if abs(v := 1 + num / c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def design(df: DataFrame, y: str, xs: list[str], effects: list[str] | None = None, extra: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Complete rows with y as ``__y`` and the named columns as doubles: constant, regressors, a dummy per level of each effect but the first."""
    names, cols = ["const"], [F.lit(1.0).alias("x0")]
    keep = df.dropna(subset=[y, *xs, *(effects or [])])
    for x in xs:
        names.append(x)
        cols.append(F.col(x).cast("double").alias(f"x{len(names) - 1}"))
    for e in effects or []:
        levels = sorted(r[0] for r in keep.select(e).distinct().limit(5001).collect())
        if len(levels) > 5000:
            raise ValueError(f"{e} has more than 5000 levels; demean within it instead")
        for level in levels[1:]:
            names.append(f"{e}={level}")
            cols.append((F.col(e) == level).cast("double").alias(f"x{len(names) - 1}"))
    return keep.select(F.col(y).cast("double").alias("__y"), *cols, *(extra or [])), names


def _sum_matrix(df: DataFrame, weight: Column, k: int) -> np.ndarray:
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{n}") for n, (i, j) in enumerate(cells)]).first()
    out = np.zeros((k, k))
    for n, (i, j) in enumerate(cells):
        out[i, j] = out[j, i] = row[n]
    return out


class Fit:
    """An OLS fit: coefficients, covariance, residual sums; the data stay where they are."""

    def __init__(self, df: DataFrame, names: list[str], cov: str = "HC1", cluster: str | None = None):
        k = len(names)
        self.df, self.names, self.k = df, names, k
        sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("syy"), *[F.sum(F.col("__y") * F.col(f"x{i}")).alias(f"v{i}") for i in range(k)]).first()
        self.n = sums["n"]
        xx = _sum_matrix(df, F.lit(1.0), k)
        self.inv = np.linalg.pinv(xx)
        self.beta = self.inv @ np.array([sums[f"v{i}"] for i in range(k)])
        self.fitted = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(self.beta)), F.lit(0.0))
        self.residual = F.col("__y") - self.fitted
        self.leverage = sum((F.lit(float(self.inv[i, j])) * F.col(f"x{i}") * F.col(f"x{j}") for i in range(k) for j in range(k)), F.lit(0.0))
        r = df.agg(F.sum(self.residual * self.residual)).first()[0]
        self.ssr, self.tss = r, sums["syy"] - sums["sy"] ** 2 / self.n
        self.sigma2 = r / (self.n - k)
        self.r2 = 1 - r / self.tss if self.tss else float("nan")
        self.groups = None
        if cov == "nonrobust":
            self.cov = self.sigma2 * self.inv
        elif cov == "cluster":
            scores = df.groupBy(cluster).agg(*[F.sum(self.residual * F.col(f"x{i}")).alias(f"x{i}") for i in range(k)])
            self.groups = scores.count()
            g, n = self.groups, self.n
            self.cov = self.inv @ _sum_matrix(scores, F.lit(1.0), k) @ self.inv * (g / (g - 1) * (n - 1) / (n - k))
        else:
            e2 = self.residual * self.residual
            weight = e2 / ((1 - self.leverage) * (1 - self.leverage)) if cov == "HC3" else e2
            self.cov = self.inv @ _sum_matrix(df, weight, k) @ self.inv * (self.n / (self.n - k) if cov == "HC1" else 1)
        self.se = np.sqrt(np.diag(self.cov))

    def table(self) -> list[tuple[str, float, float, float, float]]:
        """(term, estimate, standard error, t, p)."""
        dof = (self.groups - 1) if self.groups else self.n - self.k
        return [(m, float(b), float(s), float(b / s), t_two_sided(b / s, dof)) for m, b, s in zip(self.names, self.beta, self.se)]

    def combination(self, weights: dict[str, float]) -> tuple[float, float, float]:
        """Estimate, standard error and p of a linear combination of coefficients."""
        w = np.array([weights.get(m, 0.0) for m in self.names])
        est, se = float(w @ self.beta), float(np.sqrt(w @ self.cov @ w))
        return est, se, 2 * (1 - normal_cdf(abs(est / se)))

    def breusch_pagan(self) -> tuple[float, float]:
        """LM statistic and p of heteroscedasticity."""
        aux = Fit(self.df.withColumn("__y", self.residual * self.residual), self.names, "nonrobust")
        lm = self.n * aux.r2
        return lm, chi2_upper(lm, self.k - 1)

    def jarque_bera(self) -> tuple[float, float]:
        r = self.df.agg(F.skewness(self.residual).alias("s"), F.kurtosis(self.residual).alias("k")).first()
        jb = self.n / 6 * (r["s"] ** 2 + r["k"] ** 2 / 4)
        return jb, chi2_upper(jb, 2)

    def reset(self) -> tuple[float, float]:
        """F and p of adding the squared and cubed fitted values."""
        scale = float(self.df.agg(F.max(F.abs(self.fitted))).first()[0] or 1.0)
        f = self.fitted / F.lit(scale)
        wide = self.df.withColumn("__f", f).withColumn(f"x{self.k}", F.col("__f") ** 2).withColumn(f"x{self.k + 1}", F.col("__f") ** 3)
        big = Fit(wide, [*self.names, "f2", "f3"], "nonrobust")
        stat = (self.ssr - big.ssr) / 2 / (big.ssr / (self.n - self.k - 2))
        return stat, f_upper(stat, 2, self.n - self.k - 2)

    def cooks(self) -> DataFrame:
        """The rows with leverage ``h`` and Cook's distance ``cook``."""
        h, e = F.col("h"), F.col("e")
        return self.df.withColumn("h", self.leverage).withColumn("e", self.residual).withColumn("cook", e * e / (self.k * self.sigma2) * h / ((1 - h) * (1 - h)))

    def condition_number(self) -> float:
        v = np.linalg.eigvalsh(np.linalg.pinv(self.inv))
        return float(np.sqrt(v[-1] / v[0]))


def ols(df: DataFrame, y: str, xs: list[str], effects: list[str] | None = None, cov: str = "HC1", cluster: str | None = None) -> Fit:
    """Least squares of y on xs, a constant and fixed effects; cov is nonrobust, HC0, HC1, HC3 or cluster. Rows with nulls are left out."""
    rows, names = design(df, y, xs, effects, [cluster] if cluster else None)
    return Fit(rows, names, cov, cluster)


def vif(df: DataFrame, xs: list[str]) -> list[tuple[str, float]]:
    """Variance inflation of each regressor, from one pass of cross sums."""
    rows = df.dropna(subset=xs)
    k = len(xs)
    r = rows.agg(*[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i < j]).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = r[f"c{i}_{j}"]
    return [(x, float(v)) for x, v in zip(xs, np.diag(np.linalg.pinv(m)))]


def durbin_watson(df: DataFrame, residual: str, order: str) -> DataFrame:
    """Durbin-Watson statistic in order of a numeric column without ties; ranges of it are ordered side by side, only their ends meet."""
    rows = df.where(F.col(residual).isNotNull() & F.col(order).isNotNull()).select(F.col(residual).cast("double").alias("e"), F.col(order).cast("double").alias("o"))
    edges = sorted(set(rows.stat.approxQuantile("o", [i / 64 for i in range(1, 64)], 0.002)))
    rows = rows.withColumn("b", sum(((F.col("o") > e).cast("int") for e in edges), F.lit(0)))
    w = Window.partitionBy("b").orderBy("o")
    inner = rows.withColumn("d", F.col("e") - F.lag("e").over(w)).groupBy("b").agg(F.sum(F.col("d") * F.col("d")).alias("d2"), F.sum(F.col("e") * F.col("e")).alias("e2"), F.min_by("e", "o").alias("first"), F.max_by("e", "o").alias("last"))
    seam = F.col("first") - F.lag("last").over(Window.orderBy("b"))
    return inner.withColumn("seam", seam).agg(((F.sum(F.coalesce("d2", F.lit(0.0))) + F.sum(F.coalesce(F.col("seam") * F.col("seam"), F.lit(0.0)))) / F.sum("e2")).alias("dw"))


class Logit:
    """Binomial GLM by Newton steps on distributed sums; y may be any share in [0, 1] (fractional logit)."""

    def __init__(self, df: DataFrame, y: str, xs: list[str], effects: list[str] | None = None, cluster: str | None = None, steps: int = 25, tolerance: float = 1e-9):
        rows, self.names = design(df, y, xs, effects, [cluster] if cluster else None)
        self.df = rows.persist()
        k = len(self.names)
        self.beta = np.zeros(k)
        for self.steps in range(1, steps + 1):
            p = self.probability()
            g = self.df.agg(*[F.sum((F.col("__y") - p) * F.col(f"x{i}")) for i in range(k)]).first()
            self.information = _sum_matrix(self.df, p * (1 - p), k)
            move = np.linalg.solve(self.information, np.array(g, float))
            self.beta = self.beta + move
            if np.abs(move).max() < tolerance:
                break
        p = self.probability()
        self.information = _sum_matrix(self.df, p * (1 - p), k)
        self.cov = np.linalg.inv(self.information)
        if cluster:
            scores = self.df.groupBy(cluster).agg(*[F.sum((F.col("__y") - p) * F.col(f"x{i}")).alias(f"x{i}") for i in range(k)])
            g = scores.count()
            self.cov = self.cov @ _sum_matrix(scores, F.lit(1.0), k) @ self.cov * (g / (g - 1))
        self.se = np.sqrt(np.diag(self.cov))
        self.positive = bool(np.linalg.eigvalsh(self.information)[0] > 0)

    def probability(self) -> Column:
        t = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(self.beta)), F.lit(0.0))
        return 1 / (1 + F.exp(-t))

    def marginal_effect(self, name: str, where: Column | None = None) -> tuple[float, float]:
        """Average marginal effect of a regressor (over the rows ``where``) and its delta-method standard error."""
        j, k = self.names.index(name), len(self.names)
        rows = self.df if where is None else self.df.where(where)
        p = self.probability()
        s = rows.agg(F.avg(p * (1 - p)), *[F.avg(p * (1 - p) * (1 - 2 * p) * F.col(f"x{i}")) for i in range(k)]).first()
        grad = self.beta[j] * np.array(s[1:], float)
        grad[j] += s[0]
        return float(self.beta[j] * s[0]), float(np.sqrt(grad @ self.cov @ grad))


def market_model(returns: DataFrame, market: DataFrame, events: DataFrame, estimation: int = 180, gap: int = 14, before: int = 2, after: int = 2) -> DataFrame:
    """(security, event_day, t, ar, car): abnormal and cumulated returns around events by R = a + b * R_market.

    ``returns`` (security, day, r), ``market`` (day, rm), ``events`` (security, event_day). Offsets count the security's own trading days;
    the estimation window ends ``gap`` + ``before`` days before the event. Events off the calendar or without a full window are left out.
    """
    w = Window.partitionBy("security").orderBy("day")
    days = returns.join(market, "day").withColumn("i", F.row_number().over(w))
    at = events.join(days.select("security", F.col("day").alias("event_day"), F.col("i").alias("e")), ["security", "event_day"])
    near = at.join(days, "security").withColumn("t", F.col("i") - F.col("e"))
    end = -(gap + before)
    est = near.where((F.col("t") >= end - estimation) & (F.col("t") < end)).groupBy("security", "event_day").agg(F.regr_intercept("r", "rm").alias("a"), F.regr_slope("r", "rm").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") == estimation)
    win = near.where((F.col("t") >= -before) & (F.col("t") <= after)).join(est, ["security", "event_day"]).withColumn("ar", F.col("r") - (F.col("a") + F.col("b") * F.col("rm")))
    run = Window.partitionBy("security", "event_day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return win.select("security", "event_day", "t", "ar", F.sum("ar").over(run).alias("car"))


def average_car(ar: DataFrame) -> DataFrame:
    """(t, events, aar, t_stat): average abnormal returns by event day and their t statistic."""
    return ar.groupBy("t").agg(F.count(F.lit(1)).alias("events"), F.avg("ar").alias("aar"), F.try_divide(F.avg("ar"), F.stddev_samp("ar") / F.sqrt(F.count(F.lit(1)))).alias("t_stat"))


#: P(N <= k) of a Poisson variable of mean one, k = 0, 1, …; beyond the last the chance is under 1e-13.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])


def poisson_weights(h: np.ndarray, draw: int) -> np.ndarray:
    """How often each row (its 64-bit hash) is drawn in a bootstrap sample: the same whenever and wherever it is computed."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64(draw * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53).astype(np.float64)


def _drawn_sums(rows: DataFrame, draws: int) -> DataFrame:
    """(draw, s, n) of rows (h, s, n): weighted sums by draw; every task sends a row a draw, no row is written out for each draw."""

    def sums(batches):
        import pyarrow as pa

        out = np.zeros((draws, 2))
        for b in batches:
            h, x = b.column("h").to_numpy(), np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s", "n")])
            for d in range(draws):
                out[d] += poisson_weights(h, d + 1) @ x
        yield pa.record_batch({"draw": pa.array(range(1, draws + 1), pa.int32()), "s": pa.array(out[:, 0]), "n": pa.array(out[:, 1])})

    return rows.mapInArrow(sums, "draw int, s double, n double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def bootstrap_means(df: DataFrame, keys: list[str], value: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """(draw, mean): Poisson bootstrap of a mean; each row's weight in a draw comes from a hash of its keys, so a lost task repeats it."""
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), *keys).alias("h"), F.col(value).cast("double").alias("s"), F.lit(1.0).alias("n"))
    return _drawn_sums(rows, draws).select("draw", F.try_divide("s", "n").alias("mean"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """(draw, mean): bootstrap of a mean by whole clusters with Poisson weights; rows are summed up per cluster first."""
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    return _drawn_sums(sums.select(F.xxhash64(F.lit(seed), F.col(cluster)).alias("h"), "s", "n"), draws).select("draw", F.try_divide("s", "n").alias("mean"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    rows = df.dropna(subset=columns)
    k = len(columns)
    r = rows.agg(*[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = r[f"c{i}_{j}"]
    return m


def factor_adequacy(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Kaiser-Meyer-Olkin measure and Bartlett's test of sphericity, from the correlation matrix."""
    m, n, k = correlation_matrix(df, columns), df.dropna(subset=columns).count(), len(columns)
    inv = np.linalg.inv(m)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    partial, off = -inv / d, ~np.eye(k, dtype=bool)
    r2, p2 = (m[off] ** 2).sum(), (partial[off] ** 2).sum()
    stat = -(n - 1 - (2 * k + 5) / 6) * np.log(np.linalg.det(m))
    return {"kmo": float(r2 / (r2 + p2)), "bartlett": float(stat), "p": chi2_upper(float(stat), k * (k - 1) / 2)}


def principal_components(df: DataFrame, columns: list[str]) -> list[tuple[int, float, float]]:
    """(component, share of variance, running share) of the standardised columns."""
    v = np.linalg.eigvalsh(correlation_matrix(df, columns))[::-1]
    share = v / v.sum()
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share)))]


def non_negative_factors(df: DataFrame, columns: list[str], factors: int, steps: int = 40, inner: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """(H, error): non-negative factorisation of the rows into ``factors`` parts, H a row a factor, and the Frobenius error.

    Multiplicative updates; in each pass the tasks find the weights of their rows for the present H and send sums of the size of H, so no row is moved
    or kept. Rows with a null or a negative value are left out.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    for c in columns:
        rows = rows.where(F.col(c) >= 0)
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()  # read in every pass
    m = len(columns)
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (factors, m)) * np.array([v or 0.0 for v in rows.agg(*[F.avg(c) for c in columns]).first()], float)

    def sums(h):
        def part(batches):
            import pyarrow as pa

            wv, ww, vv, error = np.zeros((factors, m)), np.zeros((factors, factors)), 0.0, 0.0
            for b in batches:
                v = np.column_stack([b.column(c).to_numpy() for c in columns])
                w = np.full((len(v), factors), 1.0)
                for _ in range(inner):
                    w *= (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
                wv += w.T @ v
                ww += w.T @ w
                error += ((v - w @ h) ** 2).sum()
            cells = np.r_[wv.ravel(), ww.ravel(), error]
            yield pa.record_batch({"i": pa.array(range(len(cells)), pa.int32()), "v": pa.array(cells)})

        got = {r["i"]: r["s"] for r in rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("s")).collect()}
        cells = np.array([got.get(i, 0.0) for i in range(factors * m + factors * factors + 1)])
        return cells[: factors * m].reshape(factors, m), cells[factors * m : -1].reshape(factors, factors), float(cells[-1])

    last, error = math.inf, 0.0
    for _ in range(steps):
        wv, ww, error = sums(h)
        if last - error < 1e-6 * max(error, 1e-12):
            break
        last = error
        for _ in range(inner):
            h = h * wv / np.maximum(ww @ h, 1e-12)
    else:
        error = sums(h)[2]
    rows.unpersist()
    return h, math.sqrt(error)
