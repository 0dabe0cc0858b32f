"""Queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.neardup import class_links, duplicate_groups, near_duplicate_pairs
from quern.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", "id", "channel", "text").select(F.lit("messages").alias("tbl"), F.concat("channel", F.lit(":"), F.col("id").cast("string")).alias("key"), "text")
    a = table(spark, d, "articles", "article_id", "content_text").select(F.lit("articles").alias("tbl"), F.col("article_id").cast("string").alias("key"), F.col("content_text").alias("text"))
    return m.unionByName(a)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_records(spark, d)).select("tbl", "key_a", "key_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(_records(spark, d), short=True)


def p3_class_links(spark: SparkSession, d: str) -> DataFrame:
    return class_links(_records(spark, d))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups, "p3_class_links": p3_class_links}
ORACLE: dict[str, str] = {}
