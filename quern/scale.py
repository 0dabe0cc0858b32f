"""Helpers that keep plans safe at scale: checked broadcasts, lineage cuts, sizing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Most rows, and most bytes, a side may have to be broadcast by :func:`checked_broadcast`.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row, about: those of texts and nested values as they are written out, 8 of any other column."""
    out = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        out = out + F.coalesce(size, F.lit(0)).cast("bigint") + 8
    return out


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else ``df`` as it is.

    The check reads ``df`` once, up to ``max_rows + 1`` rows, so give it a table or something cheap; beyond the
    bounds the join is left to the optimizer, which shuffles both sides.
    """
    part = df.limit(max_rows + 1)
    rows, size = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is missing a local folder is made and set, but only if the master runs in this process, as in tests: on a
    cluster every executor would write to a disk of its own and rows would be lost, so that is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, True)
        have = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is over: the folder stays to whoever owns spark.checkpoint.dir
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    It cuts the lineage and survives the loss of executors; every call gets a folder of its own. The folders go
    when the process ends; :func:`drop_materialized` removes them before, once the results that read them are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_materialized() -> None:
    """Remove the folders :func:`materialize` has written so far; no result that reads them may be used afterwards."""
    while _written:
        _remove(*_written.pop())
