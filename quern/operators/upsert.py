"""Idempotent merges of new rows into a table: the DataFrame form of insert-or-ignore and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``old`` and those of ``new`` whose key it lacks; the first write wins, also within ``new``."""
    fresh = first_by_key(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by key; a non-null new value replaces the old one, a null one does not. ``new`` has a row a key."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    cols = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in keys else F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, on, "full_outer").select(*cols)


def upsert_overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by key; the new row replaces the old one as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


replace_by_key = upsert_overwrite


def keyed_update(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` taken from ``changes`` where it has the key and a value."""
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in columns]).dropDuplicates(keys)
    out = old.join(c, keys, "left")
    return out.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])


def earliest_merge(old: DataFrame, new: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day, action): the earlier of the old and the new day per key, and what that changed: kept, set, moved or new."""
    o = old.groupBy(key).agg(F.min(day).alias("__o"))
    n = new.groupBy(key).agg(F.min(day).alias("__n"))
    j = o.withColumn("__have", F.lit(1)).join(n, key, "full_outer")
    action = F.when(F.col("__have").isNull(), "new").when(F.col("__o").isNull() & F.col("__n").isNotNull(), "set").when(F.col("__n") < F.col("__o"), "moved").otherwise("kept")
    return j.select(key, F.least("__o", "__n").alias(day), action.alias("action"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do: rows whose key an earlier output lacks."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
