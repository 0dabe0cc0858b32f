"""First-fit-decreasing packing of the items of bounded groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(sizes: list[float], budget: float) -> list[int]:
    """Bin of each size: larger ones first, each into the first bin with room; an over-large item has a bin of its own."""
    room: list[float] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            b = len(room)
            room.append(budget)
        room[b] -= sizes[i]
        out[i] = b
    return out


def pack_groups(df: DataFrame, group: str, item: str, size: str, budget: float) -> DataFrame:
    """(group, item, bin): first-fit-decreasing within each group, ties by item. A group is what one request batch is cut from, it must fit a row."""

    @F.pandas_udf("array<int>")
    def bins(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: pack(list(s), budget))

    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(size).cast("double").alias("s")))).alias("__x"))
    rows = rows.withColumn("__b", bins(F.transform("__x", lambda x: x["s"])))
    return rows.select(group, F.explode(F.arrays_zip("__x", "__b")).alias("p")).select(group, F.col("p.__x.i").alias(item), F.col("p.__b").alias("bin"))
