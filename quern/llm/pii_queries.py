"""Queries of the personal-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.pii import KINDS, find_mentions, fit_on, redact_texts
from quern.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", "id", "channel", "text").select(F.lit("messages").alias("tbl"), F.concat("channel", F.lit(":"), F.col("id").cast("string")).alias("row_key"), "text")
    c = table(spark, d, "comments", "comment_id", "text").select(F.lit("comments").alias("tbl"), F.col("comment_id").alias("row_key"), "text")
    p = table(spark, d, "posts", "post_id", "author").select(F.lit("posts").alias("tbl"), F.col("post_id").alias("row_key"), F.col("author").alias("text"))
    return m.unionByName(c).unionByName(p)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return find_mentions(texts, fit_on(texts)).where(F.col("row_key").isNotNull() & F.col("kind").isin(*KINDS)).select("tbl", "row_key", "kind", "nth").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return redact_texts(texts, fit_on(texts))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLE: dict[str, str] = {}
