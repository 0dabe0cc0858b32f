"""Aggregations: sentiment indices, profiles, counts, agreement, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(v: Column, w: Column) -> Column:
    """Mean of v by weights w over rows with a value and a positive weight; null if there are none."""
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def sentiment_metrics(relevant: Column, sentiment: Column, score: Column, weight: Column) -> list[Column]:
    """The message counts, shares, indices and scores of a group, one pass and without Python.

    Indices over an empty base are null, also the deviation of a single score.
    """
    rel = F.coalesce(relevant, F.lit(False))
    n = F.count_if(rel)
    pos, neg, neu = (F.count_if(rel & (sentiment == x)) for x in ("positive", "negative", "neutral"))
    s = F.when(rel, score)
    return [
        F.count(relevant).alias("n_all"), n.alias("n_relevant"),
        F.log1p(F.count(relevant)).alias("log_buzz_all"), F.log1p(n).alias("log_buzz_relevant"), F.try_divide(n, F.count(relevant)).alias("share_relevant"),
        pos.alias("n_positive"), neg.alias("n_negative"), neu.alias("n_neutral"),
        F.try_divide(pos, n).alias("share_positive"), F.try_divide(neg, n).alias("share_negative"),
        F.try_divide(pos - neg, n).alias("si"), F.try_divide(pos - neg, pos + neg).alias("ndi"),
        F.avg(s).alias("mean_score"), F.median(s).alias("median_score"), F.stddev_samp(s).alias("std_score"),
        weighted_mean(s, weight).alias("weighted_score"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight_sum"),
    ]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*")


def exact_percentiles(df: DataFrame, columns: list[str], probabilities: list[float], ranges: int = 64) -> DataFrame:
    """(variable, q): the exact percentiles of each column, interpolated between neighbours; nulls are left out.

    Distinct values are counted and their running counts made within ranges between approximate percentiles, which are many small tasks
    whatever the spread of the values; only the sums of the ranges are put together in one place.
    """
    x = _long(df, columns).where("x is not null")
    edges = x.groupBy("variable").agg(F.percentile_approx("x", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1000)).alias("edges"))
    counts = x.groupBy("variable", "x").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(edges), "variable")
    counts = counts.select("variable", "x", "n", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("b"))
    sums = counts.groupBy("variable", "b").agg(F.sum("n").alias("s"))
    whole = Window.partitionBy("variable")
    sums = sums.select("variable", "b", (F.sum("s").over(whole.orderBy("b")) - F.col("s")).alias("before"), F.sum("s").over(whole).alias("all"))
    inner = Window.partitionBy("variable", "b").orderBy("x")
    upto = counts.withColumn("in", F.sum("n").over(inner)).join(F.broadcast(sums), ["variable", "b"]).withColumn("upto", F.col("in") + F.col("before"))
    place = lambda p: F.lit(p) * (F.col("all") - 1)
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))
    ends = upto.groupBy("variable").agg(F.max("all").alias("all"), *[at(F.floor(place(p))).alias(f"l{i}") for i, p in enumerate(probabilities)], *[at(F.ceil(place(p))).alias(f"h{i}") for i, p in enumerate(probabilities)])
    part = lambda i, p: F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (place(p) - F.floor(place(p)))
    return ends.select("variable", F.array(*[part(i, p) for i, p in enumerate(probabilities)]).alias("q"))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n, missing, moments (bias-corrected skewness and kurtosis) and exact percentiles."""
    n, g1, g2 = F.count("x").cast("double"), F.skewness("x"), F.kurtosis("x")
    quantiles = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    out = _long(df, columns).groupBy("variable").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )
    out = out.join(exact_percentiles(df, columns, list(quantiles.values())), "variable", "left")
    return out.select("variable", "n", "missing", "mean", "std", "min", *[F.col("q")[i].alias(k) for i, k in enumerate(quantiles)], "max", "skew", "kurtosis")


def category_counts(df: DataFrame, columns: list[str], top: int = 25) -> DataFrame:
    """(variable, value, n, share, place): the ``top`` values of each column; null as 'Missing', ties by value.

    The ranking is cut to ``top`` values in every task before the shuffle.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias("value")) for c in columns])).alias("p")).select("p.*")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("n"), "value"))
    best = counts.withColumn("place", place).where(F.col("place") <= top)
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return best.crossJoin(F.broadcast(total)).select("variable", "value", "n", (F.col("n") / F.col("__n")).alias("share"), "place")


def with_total(df: DataFrame, key: str, aggs: list[Column], label: str = "TOTAL") -> DataFrame:
    """A row a key and one for all, by a single rollup."""
    return df.rollup(key).agg(F.grouping(key).alias("__g"), *aggs).withColumn(key, F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.col(key))).drop("__g")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of all pairs of values that occur; nulls as 'Missing'."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias(c)
    return df.select(value(a), value(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agree): pairs with both values, and the part that is equal."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"))


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) for each pair of columns over the rows that have both; constant columns give no pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def r(a, b):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*[r(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    return out.where(F.col("r").isNotNull() & (F.abs("r") > least))


def _cuts(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row with the two percentiles of each column as ``__column``."""
    q = exact_percentiles(df, columns, [low, high])
    return q.agg(*[F.max(F.when(F.col("variable") == c, F.col("q"))).alias(f"__{c}") for c in columns])


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns cut off at their exact global percentiles; nulls stay."""
    out = df.crossJoin(F.broadcast(_cuts(df, columns, low, high)))
    return out.select(*[F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1]).alias(c) if c in columns else F.col(c) for c in df.columns])


def cap_outliers(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, upper_only: bool = False) -> DataFrame:
    """Values beyond 1.5 times the range of the two percentiles outside them are replaced by the percentile."""
    q, x = F.col(f"__{column}"), F.col(column)
    reach = (q[1] - q[0]) * 1.5
    capped = F.when(x > q[1] + reach, q[1])
    if not upper_only:
        capped = capped.when(x < q[0] - reach, q[0])
    return df.crossJoin(F.broadcast(_cuts(df, [column], low, high))).withColumn(column, capped.otherwise(x)).drop(f"__{column}")


def collapse_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Values of fewer than ``least`` rows become ``other``."""
    common = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    out = df.join(common, F.col(column) == F.col("__v"), "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("__v", F.lit(other)))).drop("__v", "__n")
