"""Queries of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.mixing import fair_mix, mix_report, token_counts
from quern.scale import materialize
from quern.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _sizes(spark: SparkSession, d: str, tokenizer: str) -> DataFrame:
    return materialize(token_counts(table(spark, d, "documents", "doc_id", "source", "text"), tokenizer), "sizes")


def p7_mix(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return fair_mix(_sizes(spark, d, tokenizer), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes, targets = _sizes(spark, d, tokenizer), table(spark, d, "mix_targets")
    return mix_report(materialize(fair_mix(sizes, targets), "mix"), sizes, targets)


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
