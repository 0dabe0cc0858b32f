"""Queries of the contamination operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.contamination import leaked_items
from quern.sources.tables import table


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
ORACLE: dict[str, str] = {}
