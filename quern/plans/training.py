"""Queries of the general training-data operators (mixed timestamps, skewed keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.skew import frequent_keys, salted_aggregate
from quern.operators.timestamps import nonstandard_instants, publication_instants
from quern.sources.tables import table


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    return publication_instants(
        table(spark, d, "messages", "id", "channel", "date"),
        table(spark, d, "posts", "post_id", "published_at", "collected_at"),
        table(spark, d, "articles", "article_id", "date_time", "date_label", "time_label", "source_label", "fetched_at"),
        table(spark, d, "feeds"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nonstandard_instants(p1_instants(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [("messages", "channel"), ("telegram_matches", "issuer")]
    out = [frequent_keys(table(spark, d, t, k), k, 0.04).select(F.lit(t).alias("tbl"), "key_value") for t, k in parts]
    return out[0].unionByName(out[1])


def p4_channel_engagement(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages", "channel", "id", "views", "reactions", "reply_count", "parent_id")
    stats = salted_aggregate(
        m, "channel",
        sums={"views_sum": F.col("views"), "views_n": F.col("views").isNotNull().cast("bigint"), "reactions_sum": F.col("reactions"), "replies_sum": F.col("reply_count")},
        maxima={"views_max": F.col("views")}, minima={"views_min": F.col("views")},
        distinct={"message_n": F.col("id"), "parent_n": F.col("parent_id")},
    )
    return stats.withColumn("views_mean", F.round(F.try_divide(F.col("views_sum"), F.col("views_n")), 6))


def p4_issuer_mentions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telegram_matches", "issuer", "source_key", "channel", "text_len", "match_origin")
    stats = salted_aggregate(
        t, "issuer",
        sums={"text_len_sum": F.col("text_len"), "inherited_n": (F.col("match_origin") != "explicit").cast("bigint")},
        maxima={"text_len_max": F.col("text_len")},
        distinct={"source_n": F.col("source_key"), "channel_n": F.col("channel")},
    )
    return stats.withColumn("text_len_mean", F.round(F.col("text_len_sum") / F.col("n"), 6))


QUERIES = {"p1_found": p1_found, "p1_instants": p1_instants, "p4_found": p4_found, "p4_channel_engagement": p4_channel_engagement, "p4_issuer_mentions": p4_issuer_mentions}

ORACLE = {
    "p4_found": """
        SELECT 'messages' AS tbl, channel AS key_value FROM messages WHERE channel IS NOT NULL GROUP BY channel HAVING count(*) >= 0.04 * (SELECT count(*) FROM messages)
        UNION ALL
        SELECT 'telegram_matches', issuer FROM telegram_matches WHERE issuer IS NOT NULL GROUP BY issuer HAVING count(*) >= 0.04 * (SELECT count(*) FROM telegram_matches)""",
    "p4_channel_engagement": """
        SELECT channel, count(*) AS n, sum(views)::BIGINT AS views_sum, count(views) AS views_n, sum(reactions)::BIGINT AS reactions_sum, sum(reply_count)::BIGINT AS replies_sum,
               max(views) AS views_max, min(views) AS views_min, count(DISTINCT id) AS message_n, count(DISTINCT parent_id) AS parent_n,
               round(sum(views)::DOUBLE / nullif(count(views), 0), 6) AS views_mean
        FROM messages WHERE channel IS NOT NULL GROUP BY channel""",
    "p4_issuer_mentions": """
        SELECT issuer, count(*) AS n, sum(text_len)::BIGINT AS text_len_sum, sum(CASE WHEN match_origin <> 'explicit' THEN 1 WHEN match_origin IS NOT NULL THEN 0 END)::BIGINT AS inherited_n,
               max(text_len) AS text_len_max, count(DISTINCT source_key) AS source_n, count(DISTINCT channel) AS channel_n,
               round(sum(text_len)::DOUBLE / count(*), 6) AS text_len_mean
        FROM telegram_matches WHERE issuer IS NOT NULL GROUP BY issuer""",
}
