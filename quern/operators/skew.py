"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

Heavy keys (at least ``1/HEAVY_SHARE`` of the rows) get a salt, partial results are computed per (key, salt) and
then merged by key. The salt of row i of a partition is i modulo the number of salts: evenly spread and the same
when a lost task is computed again. Distinct values are salted by the value itself, so that partial sets are disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows; there are at most 1 / HEAVY_SHARE of them, whatever the size.
HEAVY_SHARE = 0.01
SALTS = 32


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key_value, n) with null keys left out; map-side combined, so that a hot key sends one row a task."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Keys that hold at least ``share`` of all rows (null keys count as rows, not as keys); at most 1/share values."""
    total = df.count()  # of a table by its footers, without reading a column
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return [r["k"] for r in counts.where(F.col("n") >= share * total).limit(int(1 / share) + 1).collect()]


def salted_aggregate(
    df: DataFrame,
    key: str,
    sums: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None,
    salts: int = SALTS,
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """One row per non-null value of ``key``: n (rows), the named sums, minima, maxima and distinct counts, exact.

    Nulls are skipped as in SQL: a sum, minimum or maximum over none is null, a distinct count 0. Repeated rows count each time.
    An empty input gives an empty result. Other columns may have any names; only ``key`` and the given expressions are read. No result may have the key's name.
    """
    sums, minima, maxima, distinct = sums or {}, minima or {}, maxima or {}, distinct or {}
    if key in {"n", *sums, *minima, *maxima, *distinct}:
        raise ValueError(f"a result can't have the name of the key: {key}")
    heavy = heavy_keys(df, key, share)
    hot = F.col("__key").isin(heavy) if heavy else F.lit(False)
    base = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"),
        *[c.alias(f"__s_{n}") for n, c in sums.items()], *[c.alias(f"__m_{n}") for n, c in minima.items()],
        *[c.alias(f"__x_{n}") for n, c in maxima.items()], *[c.alias(f"__d_{n}") for n, c in distinct.items()],
    )
    spread = F.when(hot, F.monotonically_increasing_id() % salts).otherwise(F.lit(0))
    partial = base.withColumn("__salt", spread).groupBy("__key", "__salt").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums], *[F.min(f"__m_{n}").alias(f"__m_{n}") for n in minima], *[F.max(f"__x_{n}").alias(f"__x_{n}") for n in maxima],
    )
    out = partial.groupBy("__key").agg(
        F.sum("__n").alias("n"),
        *[F.sum(f"__s_{n}").alias(n) for n in sums], *[F.min(f"__m_{n}").alias(n) for n in minima], *[F.max(f"__x_{n}").alias(n) for n in maxima],
    )
    if distinct:
        # all sets of values in one more pass: (key, salt, number of the set, value), the value as text, which tells all plain values apart
        sets = [F.struct(F.lit(i).alias("i"), F.col(f"__d_{n}").cast("string").alias("v")) for i, n in enumerate(distinct)]
        pairs = base.select("__key", F.explode(F.array(*sets)).alias("p"), hot.alias("__hot")).where("p.v is not null")
        pairs = pairs.select("__key", F.col("p.i").alias("__i"), F.col("p.v").alias("__v"), F.when(F.col("__hot"), F.pmod(F.xxhash64("p.v"), F.lit(salts))).otherwise(F.lit(0)).alias("__salt")).distinct()
        per = pairs.groupBy("__key", "__salt").agg(*[F.count_if(F.col("__i") == i).alias(n) for i, n in enumerate(distinct)])
        counts = per.groupBy("__key").agg(*[F.sum(n).alias(n) for n in distinct])
        out = out.join(counts, "__key", "left").na.fill(0, list(distinct))
    return out.withColumnRenamed("__key", key)


def frequent_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key_value, n) of keys with at least ``share`` of all rows, by the two-stage salted count."""
    counts = salted_aggregate(df.select(F.col(key).cast("string").alias("key_value")), "key_value")
    total = df.select(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("key_value", "n")
