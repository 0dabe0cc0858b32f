"""Audit reports, mappings, packing, models and a stream on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import values as V
from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import ml as L
from quern.operators import packing as P
from quern.operators import stats as S
from quern.operators import windows as W
from quern.plans.statistical import _orders, _table
from quern.scale import shared_dir
from quern.sources.tables import table
from quern.streaming.ingest import distinct_events, window_counts


def mapped_priorities(spark, d):
    """Labels by dictionary, buckets by limits, unmapped as null."""
    o = table(spark, d, "orders", "o_orderpriority", "o_totalprice")
    code = F.create_map(*[F.lit(x) for kv in {"1-URGENT": 12, "2-HIGH": 9, "3-MEDIUM": 6, "4-NOT SPECIFIED": 3}.items() for x in kv])[F.col("o_orderpriority")]
    bucket = F.when(code >= 12, "High").when(code >= 6, "Middle").when(code.isNotNull(), "Low").otherwise("Missing")
    return o.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(code), 6).alias("mean_code"))


def fallback_chain(spark, d):
    """The first given of three columns and where it came from, by article."""
    a = table(spark, d, "articles", "article_id", "date_time", "date_label", "fetched_at")
    source = F.when(F.col("date_time").isNotNull(), "date_time").when(F.col("date_label").isNotNull(), "date_label").when(F.col("fetched_at").isNotNull(), "fetched_at")
    return a.select("article_id", F.coalesce("date_time", "date_label", "fetched_at").alias("written"), source.alias("source"))


def dotted_dates(spark, d):
    """'dd.mm.yyyy…' and ISO labels as dates, others null."""
    a = table(spark, d, "articles", "article_id", "date_label")
    x = F.col("date_label")
    day = F.when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}"), F.try_to_date(F.substring(x, 1, 10), "dd.MM.yyyy")).when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))
    return a.select("article_id", day.alias("day"))


def substring_pairs(spark, d):
    a = table(spark, d, "issuer_aliases", "issuer", "alias", "alias_type").where("alias_type = 'short_name'")
    return J.substring_match(a, table(spark, d, "issuer_aliases", "issuer"), "alias", "issuer")


def nested_lines(spark, d):
    """Orders with their lines as a sorted list."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return l.groupBy("l_orderkey").agg(items.alias("i")).select("l_orderkey", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


def fold_deltas(spark, d):
    """Difference of two results by fold, and its spread."""
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice", "o_orderstatus").withColumn("year", F.year("o_orderdate"))
    f = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("year").agg(F.avg("o_totalprice").alias(s))
    j = f("F").join(f("O"), "year").withColumn("delta", F.col("F") - F.col("O"))
    return j.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("delta"), 4).alias("mean"), F.round(F.percentile("delta", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("delta", F.lit(0.975)), 4).alias("high"))


def review_precision(spark, d):
    """Precision of reviewed labels by group; labels in any spelling, unreadable ones not counted."""
    c = table(spark, d, "telegram_match_candidates", "note", "match_score", "entity_type")
    label = V.label01(F.when(F.col("match_score") > 0.8, F.lit(" Yes")).when(F.col("match_score") > 0.5, "fp").otherwise("?"))
    return c.groupBy("note").agg(F.count(label).alias("reviewed"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("correct"), F.round(F.avg(label), 6).alias("precision"))


def confidence_by_class(spark, d):
    c = table(spark, d, "telegram_match_candidates", "note", "match_score")
    x = F.col("match_score")
    return c.groupBy("note").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"))


def alias_type_report(spark, d):
    """Kinds of aliases over two tables: sums, largest count, sources, and a flag."""
    parts = [table(spark, d, t, "alias_types").select(F.lit(t).alias("src"), F.explode(V.json_strings(F.col("alias_types"))).alias("kind")) for t in ("telegram_matches", "telegram_match_candidates")]
    per = parts[0].unionByName(parts[1]).groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.array_join(F.array_sort(F.collect_set("src")), ", ").alias("sources")).withColumn("suspicious", F.col("n") < 100)


def mention_distribution(spark, d):
    """How mentions spread over issuers."""
    t = table(spark, d, "telegram_matches", "issuer").groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.count(F.lit(1)).alias("issuers"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.max("n").alias("most"))


def channel_progress(spark, d):
    m = table(spark, d, "messages", "channel", "id", "parent_id", "date")
    return m.groupBy("channel").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("parent_id").alias("replies"), F.count_if(F.col("date").isNull()).alias("undated"))


def layer_counts(spark, d):
    """Texts by layer of topic and source, with totals."""
    parts = [table(spark, d, t, "text").select(F.lit(t).alias("src"), "text") for t in ("messages", "posts", "comments")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bond, primary = T.flag_any(F.col("text"), ["облигац", "купон"]), T.flag_any(F.col("text"), ["букбилд", "размещ"])
    flags = u.select("src", (bond | primary).cast("int").alias("bond"), primary.cast("int").alias("primary_flag"))
    return A.with_total(flags, "src", [F.count(F.lit(1)).alias("n"), F.sum("bond").alias("bond"), F.sum("primary_flag").alias("primary_n")])


def first_examples(spark, d):
    """Three example mentions an issuer."""
    t = table(spark, d, "telegram_matches", "issuer", "source_key").distinct()
    top = W.top_per_group(t, ["issuer"], [F.col("source_key")], 3)
    return top.groupBy("issuer").agg(F.array_join(F.array_sort(F.collect_list("source_key")), "; ").alias("examples"))


def packed_lines(spark, d):
    """Lines of an order packed by first-fit-decreasing into bins of 60 units."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return P.pack_groups(l, "l_orderkey", "l_linenumber", "l_quantity", 60.0).groupBy("l_orderkey").agg((F.max("bin") + 1).cast("bigint").alias("bins"))


def interaction_terms(spark, d):
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    q, s, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return l.agg(*[F.round(F.sum(x), 4).alias(n) for n, x in {"q2": q * q, "qs": q * s, "qt": q * t, "st": s * t, "pos": V.positive_part(s - t), "neg": V.negative_part(s - t)}.items()])


def cluster_bootstrap_mean(spark, d):
    b = S.cluster_bootstrap(table(spark, d, "events", "user_id", "value"), "user_id", "value", 999)
    return b.agg(F.count(F.lit(1)).alias("draws"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def factor_tests(spark, d):
    l = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    pca = S.principal_components(l, l.columns)
    return _table(spark, [*S.factor_adequacy(l, l.columns).items(), *[(f"component_{i}", s) for i, s, _ in pca]], "term", "value")


def temporal_models(spark, d):
    return _table(spark, L.model_scores(_orders(spark, d), ["balance", "price"], "urgent", "year", 2000), "term", "auc")


def kmeans_costs(spark, d):
    return _table(spark, [(f"k{k}", c) for k, c in L.kmeans_elbow(_orders(spark, d), ["balance", "price"], 4)], "term", "cost")


def multinomial_terms(spark, d):
    o = _orders(spark, d)
    o = o.withColumn("cls", F.when(F.col("price") > 200, 2.0).when(F.col("price") > 100, 1.0).otherwise(0.0))
    return _table(spark, [(f"{c}:{t}", v) for c, t, v in L.multinomial(o, ["balance", "year"], "cls")], "term", "coefficient")


def prediction_errors(spark, d):
    """Errors of the mean price of the part's size as a guess of its price."""
    p = table(spark, d, "part", "p_size", "p_retailprice")
    g = p.groupBy("p_size").agg(F.avg("p_retailprice").alias("guess"))
    out = L.regression_scores(p.join(g, "p_size"), "guess", "p_retailprice")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


def stream_event_windows(spark, d):
    """Events of each day by type, counted by a stream with duplicates dropped inside the watermark; the same as a batch."""
    batch = table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value")
    counts = window_counts(distinct_events(stream, ["event_id"], "ts", "40 days"), "ts", "1 day", ["event_type"], "value", None)
    out, state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/v")).start()
    q.awaitTermination()
    got = spark.read.schema(counts.schema).parquet(f"{out}/v")
    return got.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_NAMES = """mapped_priorities fallback_chain dotted_dates substring_pairs nested_lines fold_deltas review_precision confidence_by_class alias_type_report mention_distribution channel_progress layer_counts first_examples
packed_lines interaction_terms cluster_bootstrap_mean factor_tests temporal_models kmeans_costs multinomial_terms prediction_errors stream_event_windows"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

ORACLE = {
    "mapped_priorities": "WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 9 WHEN '3-MEDIUM' THEN 6 WHEN '4-NOT SPECIFIED' THEN 3 END k FROM orders) SELECT CASE WHEN k >= 12 THEN 'High' WHEN k >= 6 THEN 'Middle' WHEN k IS NOT NULL THEN 'Low' ELSE 'Missing' END bucket, count(*) n, round(avg(k), 6) mean_code FROM c GROUP BY 1",
    "fallback_chain": "SELECT article_id, coalesce(date_time, date_label, fetched_at) written, CASE WHEN date_time IS NOT NULL THEN 'date_time' WHEN date_label IS NOT NULL THEN 'date_label' WHEN fetched_at IS NOT NULL THEN 'fetched_at' END source FROM articles",
    "dotted_dates": "SELECT article_id, CASE WHEN regexp_matches(date_label, '^\\d{2}\\.\\d{2}\\.\\d{4}') THEN try_strptime(left(date_label, 10), '%d.%m.%Y')::DATE WHEN regexp_matches(date_label, '^\\d{4}-\\d{2}-\\d{2}') THEN try_cast(left(date_label, 10) AS DATE) END AS day FROM articles",
    "substring_pairs": "SELECT DISTINCT a.alias, b.issuer FROM issuer_aliases a, issuer_aliases b WHERE a.alias_type = 'short_name' AND (contains(lower(b.issuer), lower(a.alias)) OR contains(lower(a.alias), lower(b.issuer)))",
    "nested_lines": "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1",
    "fold_deltas": "WITH f AS (SELECT year(o_orderdate) y, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') d FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0) SELECT count(*) folds, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.025), 4) low, round(quantile_cont(d, 0.975), 4) high FROM f",
    "review_precision": "WITH c AS (SELECT note, CASE WHEN match_score > 0.8 THEN 1 WHEN match_score > 0.5 THEN 0 END l FROM telegram_match_candidates) SELECT note, count(l) reviewed, coalesce(sum(l), 0)::BIGINT correct, round(avg(l), 6) AS precision FROM c GROUP BY 1",
    "confidence_by_class": "SELECT note, count(match_score) n, round(avg(match_score), 6) AS mean, round(median(match_score), 6) AS median, min(match_score) low, max(match_score) high FROM telegram_match_candidates GROUP BY 1",
    "alias_type_report": """WITH u AS (SELECT 'telegram_matches' src, unnest(from_json(alias_types, '["VARCHAR"]')) kind FROM telegram_matches UNION ALL SELECT 'telegram_match_candidates', unnest(from_json(alias_types, '["VARCHAR"]')) FROM telegram_match_candidates), p AS (SELECT src, kind, count(*) n FROM u GROUP BY ALL)
        SELECT kind, sum(n)::BIGINT n, max(n) most, string_agg(src, ', ' ORDER BY src) sources, sum(n) < 100 suspicious FROM p GROUP BY kind""",
    "mention_distribution": "WITH t AS (SELECT issuer, count(*) n FROM telegram_matches GROUP BY 1) SELECT count(*) issuers, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.95), 6) p95, max(n) most FROM t",
    "channel_progress": "SELECT channel, min(id) first_id, max(id) last_id, count(parent_id) replies, count(*) FILTER (date IS NULL) undated FROM messages GROUP BY 1",
    "layer_counts": """WITH u AS (SELECT 'messages' src, text FROM messages UNION ALL SELECT 'posts', text FROM posts UNION ALL SELECT 'comments', text FROM comments)
        SELECT coalesce(src, 'TOTAL') src, count(*) n, count(*) FILTER (regexp_matches(lower(text), 'облигац|купон|букбилд|размещ')) bond, count(*) FILTER (regexp_matches(lower(text), 'букбилд|размещ')) primary_n FROM u GROUP BY ROLLUP (src)""",
    "first_examples": "SELECT issuer, string_agg(source_key, '; ' ORDER BY source_key) examples FROM (SELECT * FROM (SELECT DISTINCT issuer, source_key FROM telegram_matches) QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY source_key) <= 3) GROUP BY 1",
    "interaction_terms": "SELECT round(sum(l_quantity * l_quantity), 4) q2, round(sum(l_quantity * l_discount), 4) qs, round(sum(l_quantity * l_tax), 4) qt, round(sum(l_discount * l_tax), 4) st, round(sum(greatest(l_discount - l_tax, 0)), 4) pos, round(sum(greatest(l_tax - l_discount, 0)), 4) neg FROM lineitem",
    "prediction_errors": "WITH p AS (SELECT p_retailprice y, avg(p_retailprice) OVER (PARTITION BY p_size) g FROM part) SELECT count(*) n, round(sqrt(avg((y - g) ** 2)), 6) rmse, round(avg(abs(y - g)), 6) mae, round(1 - sum((y - g) ** 2) / (var_pop(y) * count(*)), 6) r2 FROM p",
    "stream_event_windows": "SELECT ts::DATE AS day, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL",
}
