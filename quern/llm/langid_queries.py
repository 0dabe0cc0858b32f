"""Queries of the language operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.langid import identify_languages, label_errors
from quern.sources.tables import table


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return identify_languages(table(spark, d, "documents", "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return label_errors(p8_languages(spark, d))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return p8_languages(spark, d).select("doc_id", F.posexplode("passages").alias("nth", "p")).select("doc_id", "nth", "p.*")


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages, "p8_passages": p8_passages}
ORACLE: dict[str, str] = {}
