"""Window operations, sampling, splits and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scale import checked_broadcast


def demean(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Adds c + '_dm': the column less its mean within the group. The means are aggregated first, so a hot group is no window."""
    means = df.groupBy(F.col(group).alias("__g")).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    out = df.join(checked_broadcast(means), F.col(group).eqNullSafe(F.col("__g")), "left")
    return out.select(*df.columns, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_dm") for c in columns])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``place``; Spark prunes to k a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def cumulative(df: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, cdf): the empirical distribution over distinct values; running sums over ranges, not over one task's rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.stat.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.002)
    bucket = sum(((F.col(value) > e).cast("int") for e in sorted(set(edges))), F.lit(0))
    counts = counts.withColumn("__b", bucket)
    sums = counts.groupBy("__b").agg(F.sum("n").alias("__s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__all"))
    inner = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("__in", F.sum("n").over(inner)).join(F.broadcast(sums), "__b")
    return out.select(value, "n", ((F.col("__in") + F.col("__before")) / F.col("__all")).alias("cdf"))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds c + '_z' by mean and population deviation; constant columns give null."""
    one = df.agg(*[F.avg(c).alias(f"__m{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s{c}") for c in columns])
    out = df.crossJoin(F.broadcast(one))
    return out.select(*df.columns, *[F.try_divide(F.col(c) - F.col(f"__m{c}"), F.col(f"__s{c}")).alias(f"{c}_z") for c in columns])


def seeded_order(seed: int, *keys: str) -> Column:
    """A random order that is the same on every run."""
    return F.xxhash64(F.lit(seed), *keys)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """n rows, or n of each group, picked at random by ``seed``: a sampling operator, its limit is its purpose."""
    order = [seeded_order(seed, *keys), *keys]
    if not group:
        return df.orderBy(*order).limit(n)
    return top_per_group(df, group, order, n).drop("place")


def stratified_split(df: DataFrame, keys: list[str], label: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``part``: 'test' for the share of each label by random order, else 'train'; the place in the order comes from counted hash ranges."""
    h = seeded_order(seed, *keys)
    rows = df.withColumn("__h", h).withColumn("__b", F.pmod(F.shiftrightunsigned(h, 52), F.lit(4096)))
    sums = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(label).orderBy("__b")
    sums = sums.select(F.col(label).alias("__l"), F.col("__b").alias("__sb"), F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(label)).alias("__all"))
    inner = Window.partitionBy(label, "__b").orderBy("__h", *keys)
    out = rows.withColumn("__in", F.row_number().over(inner)).join(checked_broadcast(sums), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__sb")))
    test = F.col("__in") + F.col("__before") <= F.round(F.col("__all") * test_share)
    return out.withColumn("part", F.when(test, "test").otherwise("train")).select(*df.columns, "part")


def folds(df: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 by a seeded hash."""
    return df.withColumn("fold", F.pmod(seeded_order(seed, *keys), F.lit(k)).cast("int"))


def year_folds(df: DataFrame, year: str, first: int, last: int, span: int | None = None) -> DataFrame:
    """Each row once per fold it belongs to: ``test_year`` and ``part``. Training takes all earlier years, or the ``span`` years before."""
    tests = F.sequence(F.lit(first), F.lit(last))
    out = df.withColumn("test_year", F.explode(tests)).where(F.col(year) <= F.col("test_year"))
    if span:
        out = out.where(F.col(year) >= F.col("test_year") - span)
    return out.withColumn("part", F.when(F.col(year) == F.col("test_year"), "test").otherwise("train"))


def greedy_batches(df: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """Adds ``batch`` (from 0 within the group): rows in order, a new batch once items or size would exceed the budget.

    The fold is an aggregate over the group's sorted (order, size) pairs, inside the JVM; an item over the budget is a batch of its own.
    """
    state = "struct<b:bigint,n:bigint,s:bigint,out:array<bigint>>"
    items = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(size).cast("bigint").alias("s")))).alias("__items"))

    def step(acc, x):
        fits = (acc["n"] < most_items) & ((acc["s"] + x["s"]) <= most_size)
        opens = (acc["n"] > 0) & ~fits
        b = acc["b"] + opens.cast("bigint")
        n = F.when(opens, F.lit(1)).otherwise(acc["n"] + 1).cast("bigint")
        s = F.when(opens, x["s"]).otherwise(acc["s"] + x["s"])
        return F.struct(b.alias("b"), n.alias("n"), s.alias("s"), F.concat(acc["out"], F.array(b)).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out")).cast(state)
    folded = items.select(group, "__items", F.aggregate("__items", zero, step).alias("__acc"))
    pairs = folded.select(group, F.explode(F.arrays_zip(F.col("__items"), F.col("__acc.out").alias("batch"))).alias("p"))
    return pairs.select(group, F.col(f"p.__items.{order}").alias(order), F.col("p.__items.s").alias(size), F.col("p.batch").alias("batch"))


def runs(df: DataFrame, group: list[str], order: list, value: str) -> DataFrame:
    """Adds ``run``: the number of the stretch of equal values within the group, from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
