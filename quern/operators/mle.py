"""Maximum likelihood on distributed rows: Tobit and bivariate probit by BHHH steps.

Each step is one pass: tasks turn their Arrow batches into row scores (derivatives of the log-likelihood by central differences) and
return sums only: the likelihood, the gradient and the outer products of scores, a (k+1) x (k+1) matrix a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.stats import poisson_weights

# log(erfc(z)) + z^2 for 0 <= z <= 26 as a polynomial in t = 2 / (2 + z), fitted once to the library's function
_LEAST_T = 2 / 28
_ERFC = np.polynomial.chebyshev.Chebyshev.interpolate(np.vectorize(lambda t: math.log(math.erfc(2 / t - 2)) + (2 / t - 2) ** 2), 40, domain=[_LEAST_T, 1])


def _erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function, elementwise, to about 1e-12 of its value; 0 (or 2) beyond 26."""
    z = np.minimum(np.abs(x), 26.0)
    y = np.where(np.abs(x) > 26, 0.0, np.exp(_ERFC(2 / (2 + z)) - z * z))
    return np.where(x < 0, 2 - y, y)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def bivariate_cdf(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """P(X < a, Y < b) of standard normals with correlation r, by quadrature over the correlation."""
    a, b = np.asarray(a, float)[:, None], np.asarray(b, float)[:, None]
    top = np.arcsin(np.clip(np.asarray(r, float), -0.999999, 0.999999))[:, None]
    s = np.sin(top * (1 + _NODES[None, :]) / 2)
    inner = np.exp(-(a * a + b * b - 2 * a * b * s) / (2 * (1 - s * s)))
    return normal_cdf(a[:, 0]) * normal_cdf(b[:, 0]) + (inner * _WEIGHTS[None, :]).sum(axis=1) * top[:, 0] / (4 * math.pi)


class Estimate:
    """Parameters with names, covariance, log-likelihood and how the search ended."""

    def __init__(self, names, theta, cov, loglik, gradient, steps):
        self.names, self.theta, self.cov, self.loglik, self.gradient, self.steps = names, theta, cov, loglik, gradient, steps
        self.se = np.sqrt(np.diag(cov))
        self.positive = bool(np.linalg.eigvalsh(cov)[0] > 0)


def maximise(df: DataFrame, columns: list[str], loglik: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, names: list[str], steps: int = 60, tolerance: float = 1e-6) -> Estimate:
    """The maximum of the sum over complete rows of ``loglik(theta, matrix of columns)``; steps are halved while the likelihood falls."""
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna().persist()
    k = len(start)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches):
            total = np.zeros((k + 1, k + 1))
            for b in batches:
                m = np.column_stack([b.column(i).to_numpy() for i in range(b.num_columns)])
                h = 1e-5 * np.maximum(1, np.abs(theta))
                score = np.column_stack([(loglik(theta + h[j] * np.eye(k)[j], m) - loglik(theta - h[j] * np.eye(k)[j], m)) / (2 * h[j]) for j in range(k)])
                total[0, 0] += loglik(theta, m).sum()
                total[0, 1:] += score.sum(axis=0)
                total[1:, 1:] += score.T @ score
            yield pa.record_batch({"i": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

        got = {r["i"]: r["s"] for r in rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("s")).collect()}
        total = np.array([got.get(i, 0.0) for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
        return total[0, 0], total[0, 1:], total[1:, 1:]

    theta = np.array(start, float)
    value, g, opg = sums(theta)
    for step in range(1, steps + 1):
        move = np.linalg.solve(opg + 1e-9 * np.eye(k), g)
        size = 1.0
        while size > 1e-4:
            new = sums(theta + size * move)
            if np.isfinite(new[0]) and new[0] >= value - 1e-9:
                break
            size /= 2
        done = abs(new[0] - value) < tolerance * (1 + abs(value)) * 1e-3
        theta, (value, g, opg) = theta + size * move, new
        if done:
            break
    rows.unpersist()
    return Estimate(names, theta, np.linalg.pinv(opg), value, g, step)


def tobit(df: DataFrame, y: str, xs: list[str], left: float = 0.0) -> Estimate:
    """Regression of y censored from below at ``left``: constant, slopes and ln(sigma)."""
    k = len(xs) + 1

    def loglik(theta, m):
        mean = theta[0] + m[:, 1:] @ theta[1:k]
        s = math.exp(min(max(theta[k], -20), 20))
        z = (m[:, 0] - mean) / s
        free = -0.5 * z * z - math.log(s) - 0.5 * math.log(2 * math.pi)
        return np.where(m[:, 0] > left, free, np.log(np.maximum(normal_cdf((left - mean) / s), 1e-300)))

    one = df.agg(F.avg(y), F.stddev_samp(y)).first()
    return maximise(df, [y, *xs], loglik, np.r_[one[0], np.zeros(k - 1), math.log(max(one[1], 1e-6))], ["const", *xs, "ln_sigma"])


def biprobit(df: DataFrame, y1: str, y2: str, xs1: list[str], xs2: list[str]) -> Estimate:
    """Two probits whose errors correlate (Gaussian copula): both equations and atanh(rho)."""
    k1, k2 = len(xs1) + 1, len(xs2) + 1

    def loglik(theta, m):
        q1, q2 = 2 * m[:, 0] - 1, 2 * m[:, 1] - 1
        a = theta[0] + m[:, 2 : 2 + k1 - 1] @ theta[1:k1]
        b = theta[k1] + m[:, 2 + k1 - 1 :] @ theta[k1 + 1 : k1 + k2]
        return np.log(np.maximum(bivariate_cdf(q1 * a, q2 * b, q1 * q2 * math.tanh(theta[-1])), 1e-300))

    return maximise(df, [y1, y2, *xs1, *xs2], loglik, np.zeros(k1 + k2 + 1), ["const_1", *[f"{x}_1" for x in xs1], "const_2", *[f"{x}_2" for x in xs2], "atanh_rho"])


def bootstrap_auc(df: DataFrame, scores: list[str], label: str, keys: list[str], draws: int = 2000, cells: int = 1000, seed: int = 1) -> DataFrame:
    """(draw, one AUC per score): Poisson bootstrap over rows, the same weights for every score. The difference of two columns is the paired difference.

    Scores are read as the range between ``cells`` percentiles they lie in, so crowded scores keep their order. Tasks keep the counts of a draw's cells and
    send them once; rows are neither written out for each draw nor sorted.
    """
    rows = df.dropna(subset=[*scores, label]).select(F.xxhash64(F.lit(seed), *keys).alias("h"), (F.col(label) == 1).cast("double").alias("y"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
    edges = [np.unique(q) for q in rows.approxQuantile([f"s{i}" for i in range(len(scores))], [k / cells for k in range(1, cells)], 0.1 / cells)] if scores else []

    def count(batches):
        held = [np.zeros((draws, 2, len(e) + 1)) for e in edges]
        for b in batches:
            h, y = b.column("h").to_numpy(), b.column("y").to_numpy()
            at = [np.searchsorted(e, b.column(f"s{i}").to_numpy()) for i, e in enumerate(edges)]
            for d in range(draws):
                w = poisson_weights(h, d + 1)
                for c, x, e in zip(at, held, edges):
                    x[d, 0] += np.bincount(c, w * y, len(e) + 1)
                    x[d, 1] += np.bincount(c, w * (1 - y), len(e) + 1)
        for i, x in enumerate(held):
            for d in range(draws):
                c = np.flatnonzero(x[d].any(axis=0))
                yield pa.record_batch({"draw": pa.array(np.full(len(c), d + 1, np.int32)), "i": pa.array(np.full(len(c), i, np.int32)), "cell": pa.array(c.astype(np.int32)), "p": pa.array(x[d, 0, c]), "n": pa.array(x[d, 1, c])})

    c = rows.mapInArrow(count, "draw int, i int, cell int, p double, n double").groupBy("draw", "i", "cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    below = Window.partitionBy("draw", "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("b", F.coalesce(F.sum("n").over(below), F.lit(0.0)))
    auc = c.groupBy("draw", "i").agg(F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))
    return auc.groupBy("draw").agg(*[F.max(F.when(F.col("i") == i, F.col("auc"))).alias(s) for i, s in enumerate(scores)])
