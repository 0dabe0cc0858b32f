"""Queries of the name-linking operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.names import link_fields
from quern.sources.tables import table


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "telegram_match_candidates", "source_key", "matched_aliases")
    c = c.select(F.lit("telegram_match_candidates").alias("tbl"), F.col("source_key").alias("row_key"), F.explode(F.from_json("matched_aliases", "array<string>")).alias("name"))
    s = table(spark, d, "searches", "id", "emitent_name").select(F.lit("searches").alias("tbl"), F.col("id").cast("string").alias("row_key"), F.col("emitent_name").alias("name"))
    p = table(spark, d, "posts", "post_id", "text").select(F.lit("posts").alias("tbl"), F.col("post_id").alias("row_key"), "text")
    return link_fields(c.unionByName(s), p, table(spark, d, "issuer_aliases", "issuer", "alias"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).where("not listed and ties = 1").select("tbl", "row_key", "issuer").distinct()


QUERIES = {"p5_found": p5_found, "p5_links": p5_links}
ORACLE: dict[str, str] = {}
