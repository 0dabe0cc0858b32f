"""Sentiment of messages around offerings: interval joins, indices, universes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.aggregates import exact_percentiles, sentiment_metrics
from quern.operators.joins import interval_join
from quern.operators.upsert import first_by_key
from quern.sources.tables import table

BUCKET = 86_400


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    m = e.where("event_type <> 'purchase'")
    cut = exact_percentiles(e, ["value"], [0.5]).select(F.col("q")[0].alias("mid"))
    sign = F.signum(F.col("value") - F.col("mid"))
    m = m.crossJoin(F.broadcast(cut))
    return m.select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("relevant"), F.when(sign > 0, "positive").when(sign < 0, "negative").otherwise("neutral").alias("sentiment"), F.col("value").alias("weight"), (F.col("value") / 100).alias("score"))


def _offerings(spark: SparkSession, d: str, days: int) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("offering_id"), F.col("user_id").alias("issuer"), F.col("ts").alias("book_open"), (F.col("ts") - F.expr(f"INTERVAL {days} DAYS")).alias("start"))


_MSG = """m AS (SELECT event_id, ts, user_id, event_type <> 'error' AS relevant, value AS weight, value / 100 AS score,
        CASE WHEN value > (SELECT median(value) FROM events) THEN 'positive' WHEN value < (SELECT median(value) FROM events) THEN 'negative' ELSE 'neutral' END AS sentiment
        FROM events WHERE event_type <> 'purchase'),
    o AS (SELECT event_id AS offering_id, user_id AS issuer, ts AS book_open FROM events WHERE event_type = 'purchase')"""


def sentiment_by_offering(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the issuer in the open interval of 3 days before the book opens, as indices, joined to all offerings."""
    o = _offerings(spark, d, 3)
    hits = interval_join(_messages(spark, d).withColumnRenamed("user_id", "issuer"), o, "issuer", "ts", "start", "book_open", "()", BUCKET)
    agg = hits.groupBy("offering_id").agg(*sentiment_metrics(F.col("relevant"), F.col("sentiment"), F.col("score"), F.col("weight")))
    out = o.select("offering_id", "issuer").join(agg, "offering_id", "left").na.fill(0, ["n_all", "n_relevant"])
    cols = ["log_buzz_relevant", "share_relevant", "share_positive", "share_negative", "si", "ndi", "mean_score", "median_score", "std_score", "weighted_score"]
    return out.select("offering_id", "issuer", "n_all", "n_relevant", "n_positive", "n_negative", "n_neutral", *[F.round(c, 6).alias(c) for c in cols])


def event_universe(spark: SparkSession, d: str) -> DataFrame:
    """Closed-open windows of 2 days, all events that hold a mention, the nearest first, with the number of events per mention."""
    o = _offerings(spark, d, 2)
    m = _messages(spark, d).withColumnRenamed("user_id", "issuer")
    hits = interval_join(m, o, "issuer", "ts", "start", "book_open", "[)", BUCKET)
    hits = hits.withColumn("events_per_mention", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    best = first_by_key(hits, ["event_id"], [F.col("book_open"), F.col("offering_id")])
    return best.select(F.concat_ws("|", F.concat(F.lit("event:"), F.col("offering_id").cast("string")), F.col("event_id").cast("string")).alias("mention_uid"), "event_id", "offering_id", "events_per_mention")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Closed-closed windows of 7 days: mentions and distinct types before each offering, and a summary by issuer."""
    o = _offerings(spark, d, 7)
    m = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").where("event_type <> 'purchase'").withColumnRenamed("user_id", "issuer")
    hits = interval_join(m, o, "issuer", "ts", "start", "book_open", "[]", BUCKET)
    per = hits.groupBy("offering_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("types"))
    per = o.select("offering_id", "issuer").join(per, "offering_id", "left").na.fill(0)
    return per.groupBy("issuer").agg(F.count(F.lit(1)).alias("offerings"), F.count_if(F.col("n") > 0).alias("covered"), F.round(F.avg("n"), 6).alias("mean_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90_n"), F.max("types").alias("most_types"))


def scope_priority(spark: SparkSession, d: str) -> DataFrame:
    """Union of two scopes for one mention and offering; the offering scope wins over the issuer scope."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    own = e.where("event_type = 'click'").select("event_id", "user_id", F.lit("offering").alias("scope"), (F.col("value") * 2).alias("v"))
    issuer = e.where("event_type <> 'error'").select("event_id", "user_id", F.lit("issuer").alias("scope"), F.col("value").alias("v"))
    one = first_by_key(own.unionByName(issuer), ["event_id"], [(F.col("scope") != "offering").cast("int"), F.col("v")])
    return one.groupBy("user_id", "scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def platform_mix(spark: SparkSession, d: str) -> DataFrame:
    """Source flags and engagement of real mentions by issuer, the source read from the key."""
    t = table(spark, d, "telegram_matches", "source_key", "issuer", "match_origin", "entity_level", "text_len")
    parts = F.split("source_key", ":", 2)
    t = t.select("issuer", parts[0].alias("channel"), (F.col("match_origin") == "inherited").cast("double").alias("inherited"), (F.col("entity_level") == "offering").cast("double").alias("offering"), "text_len")
    return t.groupBy("issuer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel").alias("channels"), F.round(F.avg("inherited"), 6).alias("share_inherited"), F.round(F.avg("offering"), 6).alias("share_offering"), F.coalesce(F.sum("text_len"), F.lit(0)).alias("chars"))


QUERIES = {"sentiment_by_offering": sentiment_by_offering, "event_universe_closed_open": event_universe, "coverage_closed_closed": coverage, "scope_priority_dedupe": scope_priority, "platform_mix": platform_mix}

ORACLE = {
    "sentiment_by_offering": f"""WITH {_MSG},
        h AS (SELECT o.offering_id, m.* FROM o JOIN m ON m.user_id = o.issuer AND m.ts > o.book_open - INTERVAL 3 DAY AND m.ts < o.book_open),
        a AS (SELECT offering_id, count(*) n_all, count(*) FILTER (relevant) n_relevant,
            count(*) FILTER (relevant AND sentiment = 'positive') n_positive, count(*) FILTER (relevant AND sentiment = 'negative') n_negative, count(*) FILTER (relevant AND sentiment = 'neutral') n_neutral,
            avg(score) FILTER (relevant) mean_score, median(score) FILTER (relevant) median_score, stddev_samp(score) FILTER (relevant) std_score,
            sum(score * weight) FILTER (relevant AND weight > 0) / sum(weight) FILTER (relevant AND weight > 0) weighted_score FROM h GROUP BY offering_id)
        SELECT o.offering_id, o.issuer, coalesce(n_all, 0) n_all, coalesce(n_relevant, 0) n_relevant, n_positive, n_negative, n_neutral,
            round(ln(1 + n_relevant), 6) log_buzz_relevant, round(n_relevant / n_all, 6) share_relevant, round(n_positive / nullif(n_relevant, 0), 6) share_positive, round(n_negative / nullif(n_relevant, 0), 6) share_negative,
            round((n_positive - n_negative) / nullif(n_relevant, 0), 6) si, round((n_positive - n_negative) / nullif(n_positive + n_negative, 0), 6) ndi,
            round(mean_score, 6) mean_score, round(median_score, 6) median_score, round(std_score, 6) std_score, round(weighted_score, 6) weighted_score
        FROM o LEFT JOIN a USING (offering_id)""",
    "event_universe_closed_open": f"""WITH {_MSG},
        h AS (SELECT m.event_id, o.offering_id, o.book_open, count(*) OVER (PARTITION BY m.event_id) events_per_mention FROM o JOIN m ON m.user_id = o.issuer AND m.ts >= o.book_open - INTERVAL 2 DAY AND m.ts < o.book_open)
        SELECT 'event:' || offering_id || '|' || event_id AS mention_uid, event_id, offering_id, events_per_mention FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY book_open, offering_id) = 1""",
    "coverage_closed_closed": """WITH o AS (SELECT event_id offering_id, user_id issuer, ts FROM events WHERE event_type = 'purchase'),
        p AS (SELECT o.offering_id, o.issuer, count(m.event_id) n, count(DISTINCT m.event_type) types FROM o LEFT JOIN events m ON m.event_type <> 'purchase' AND m.user_id = o.issuer AND m.ts BETWEEN o.ts - INTERVAL 7 DAY AND o.ts GROUP BY ALL)
        SELECT issuer, count(*) offerings, count(*) FILTER (n > 0) covered, round(avg(n), 6) mean_n, quantile_cont(n, 0.5) median_n, round(quantile_cont(n, 0.9), 6) p90_n, max(types) most_types FROM p GROUP BY issuer""",
    "scope_priority_dedupe": """WITH u AS (SELECT event_id, user_id, 'offering' scope, value * 2 v FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, 'issuer', value FROM events WHERE event_type <> 'error'),
        f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY scope <> 'offering', v) = 1)
        SELECT user_id, scope, count(*) n, round(sum(v), 4) total FROM f GROUP BY ALL""",
    "platform_mix": """SELECT issuer, count(*) n, count(DISTINCT split_part(source_key, ':', 1)) channels, round(avg(CASE WHEN match_origin = 'inherited' THEN 1.0 WHEN match_origin IS NOT NULL THEN 0.0 END), 6) share_inherited,
        round(avg(CASE WHEN entity_level = 'offering' THEN 1.0 WHEN entity_level IS NOT NULL THEN 0.0 END), 6) share_offering, coalesce(sum(text_len), 0)::BIGINT chars FROM telegram_matches GROUP BY issuer""",
}
