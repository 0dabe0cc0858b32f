"""Structured Streaming: idempotent ingestion, windows over late data, reply joins, batch upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_events(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark: insert-or-ignore without an ever growing state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, width: str, keys: list[str], value: str, delay: str | None, slide: str | None = None) -> DataFrame:
    """Rows and sum of a value per time window and keys; windows end once the watermark has passed (without ``delay``: the one the stream has)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    stream = stream.withWatermark(at, delay) if delay else stream
    return stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(stream: DataFrame, at: str, gap: str, key: str, delay: str) -> DataFrame:
    """Sessions of a key: stretches without a pause of ``gap``."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def replies_within(replies: DataFrame, parents: DataFrame, reply_key: str, parent_key: str, reply_at: str, parent_at: str, hours: int = 72) -> DataFrame:
    """Stream-stream join of replies with their parents at most ``hours`` earlier; both states are bounded by the watermark."""
    r = replies.withWatermark(reply_at, f"{hours} hours")
    p = parents.withWatermark(parent_at, f"{hours} hours")
    return r.join(p, F.expr(f"{reply_key} = {parent_key} AND {reply_at} >= {parent_at} AND {reply_at} <= {parent_at} + INTERVAL {hours} HOURS"))


def upsert_sink(path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that merges each batch into a new version of a parquet table: a rerun of a batch writes the same version.

    A batch other than the first needs the version before it: one that can't be read is an error, so that the table is never begun anew over a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = merge(batch.sparkSession.read.parquet(f"{path}/v={number - 1}"), batch, keys) if number else batch
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def within_range(stream: DataFrame, at: str, first: str, last: str, delay: str) -> DataFrame:
    """Rows from ``first`` up to, not including, ``last``, and not later than the watermark allows."""
    t = F.col(at)
    return stream.withWatermark(at, delay).where((t >= F.lit(first).cast("timestamp")) & (t < F.lit(last).cast("timestamp")))


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, name: str = "out", mode: str = "append") -> None:
    """Process what is there and stop: into a table in memory (tests, small results) or by ``write`` batch by batch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(write).start() if write else w.format("memory").queryName(name).start()
    q.awaitTermination()
