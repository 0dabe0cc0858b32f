"""Samples, conditional counts, resolution and inheritance, folds and closed-form models on the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import joins as J
from quern.operators import ml as L
from quern.operators import windows as W
from quern.plans.statistical import _orders, _table
from quern.sources.tables import table


def origin_texts(spark, d):
    """Rows and distinct texts by issuer and origin, in one pass."""
    t = table(spark, d, "telegram_matches", "issuer", "source_key", "match_origin", "text_len")
    of = lambda o: F.col("match_origin") == o
    return t.groupBy("issuer").agg(
        F.count_if(of("explicit")).alias("explicit_rows"), F.count_if(of("inherited")).alias("inherited_rows"), F.count_distinct(F.when(of("explicit"), F.col("source_key"))).alias("explicit_texts"),
        F.count_distinct(F.when(of("inherited"), F.col("source_key"))).alias("inherited_texts"), F.round(F.avg("text_len"), 6).alias("mean_len"),
    )


def first_known(spark, d):
    """The first known balance of a customer's segment by key, and the last."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("x", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    known = F.col("x").isNotNull()
    return c.groupBy("c_mktsegment").agg(F.min_by("x", F.when(known, F.col("c_custkey"))).alias("first"), F.max_by("x", F.when(known, F.col("c_custkey"))).alias("last"))


def sample_sizes(spark, d):
    """Rows and clusters of every pair of threshold and sample, by one pass over exploded memberships."""
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    least = F.explode(F.filter(F.array(*[F.lit(x) for x in (0, 50_000, 100_000, 200_000)]), lambda x: F.col("o_totalprice") >= x))
    sample = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "fixed"), F.when(F.col("o_orderstatus") == "O", "open")), lambda s: s.isNotNull()))
    long = o.select("o_custkey", least.alias("least"), "o_orderstatus").select("o_custkey", F.col("least").cast("bigint").alias("least"), sample.alias("sample"))
    return long.groupBy("least", "sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("clusters"))


def baseline_filter(spark, d):
    """Lines all of whose quality flags hold; a missing flag is none."""
    l = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    flags = [F.col("l_quantity") > 5, F.col("l_discount") <= 0.08, F.col("l_tax") >= 0.02]
    for f in flags:
        l = l.where(F.coalesce(f, F.lit(False)))
    return l.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def varying_columns(spark, d):
    """Which columns take more than one value within the sample of sold lines."""
    l = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity").where("l_linestatus = 'F'")
    one = l.agg(*[(F.min(c) < F.max(c)).alias(c) for c in l.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(False)).alias("varies")) for c in l.columns])).alias("p")).select("p.*")


def unique_in_order(spark, d):
    """Statuses of a customer's orders in the order of their first occurrence."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return o.groupBy("o_custkey").agg(F.array_join(F.array_distinct(F.transform(items, lambda x: x["o_orderpriority"])), ",").alias("priorities"))


def next_in_order(spark, d):
    """The id after each one of its channel, and whether it is the last."""
    m = table(spark, d, "messages", "channel", "id").distinct()
    w = Window.partitionBy("channel").orderBy("id")
    return m.select("channel", "id", F.lead("id").over(w).alias("next_id"))


def last_car(spark, d):
    """The last cumulative price of each supplier within a span of thirty lines."""
    l = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"))
    first = W.top_per_group(l, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 30)
    c = W.cumulative(first, ["l_suppkey"], [F.col("place")], "p", "car")
    return c.groupBy("l_suppkey").agg(F.round(F.max_by("car", "place"), 2).alias("car"), F.max("place").cast("bigint").alias("last"))


def collected_until_known(spark, d):
    """Messages of a channel, newest first, up to the third already known one in a row: what a collector that stops there would add."""
    m = table(spark, d, "messages", "channel", "id").distinct()
    w = Window.partitionBy("channel").orderBy(F.desc("id"))
    known = F.col("id") % 5 < 2
    m = m.withColumn("known", known)
    three = F.col("known") & F.coalesce(F.lag("known", 1).over(w), F.lit(False)) & F.coalesce(F.lag("known", 2).over(w), F.lit(False))
    stop = m.select("channel", F.when(three, F.col("id")).alias("id")).groupBy("channel").agg(F.max("id").alias("stop"))
    return m.join(stop, "channel").where(~F.col("known") & (F.col("stop").isNull() | (F.col("id") > F.col("stop")))).groupBy("channel").agg(F.count(F.lit(1)).alias("added"))


def bounded_events(spark, d):
    """Events of a span of days by type, none earlier or later."""
    e = table(spark, d, "events", "ts", "event_type")
    t = F.col("ts").cast("timestamp_ntz")
    return e.where((t >= F.lit("2024-01-05").cast("timestamp_ntz")) & (t < F.lit("2024-01-20").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def training_rows(spark, d):
    """Rows fit for training each task: text of over ten characters, valid labels, confidence over the task's bound."""
    e = table(spark, d, "eval_items", "item_id", "text", "relevance_to_placement", "sentiment").withColumn("confidence", (F.col("item_id") % 21) / 20)
    e = e.where((F.length("text") > 10) & F.lower(F.trim("relevance_to_placement")).isin("yes", "no") & F.lower(F.trim("sentiment")).isin("positive", "negative", "neutral"))
    tasks = F.array(F.when(F.col("confidence") >= 0.8, F.struct(F.lit("relevance").alias("task"), F.lower(F.trim("relevance_to_placement")).alias("label"))), F.when((F.lower(F.trim("relevance_to_placement")) == "yes") & (F.col("confidence") >= 0.9), F.struct(F.lit("sentiment").alias("task"), F.lower(F.trim("sentiment")).alias("label"))))
    return e.select("item_id", F.explode(F.filter(tasks, lambda t: t.isNotNull())).alias("t")).select("item_id", "t.task", "t.label")


def label_scores(spark, d):
    """Confidence of the chosen label and score of three probabilities."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax").distinct()
    neg, pos = F.col("l_discount") * 4, F.col("l_tax") * 5
    neu = 1 - neg - pos
    return l.select("l_orderkey", "l_linenumber", F.round(F.greatest(neg, neu, pos), 6).alias("confidence"), F.round(pos - neg, 4).alias("score"))


def labelling_sample(spark, d):
    """Mentions to label by category of text, at most so many of each by a seeded order."""
    m = table(spark, d, "messages", "channel", "id", "text").groupBy("channel", "id").agg(F.min("text").alias("text"))
    t = table(spark, d, "telegram_matches", "source_key", "match_origin").groupBy("source_key").agg(F.max(F.col("match_origin") == "explicit").alias("explicit"))
    j = m.withColumn("source_key", F.concat("channel", F.lit(":"), F.col("id").cast("string"))).join(t, "source_key", "left")
    low, n = F.lower("text"), F.length("text")
    macro = functools_or([F.contains(low, F.lit(w)) for w in ("офз", "ставк", "ключев", "инфляц", "цб ")])
    kinds = F.array(
        F.when(F.col("explicit").isNotNull() & macro & (n >= 50), "macro_context"), F.when(F.col("explicit") & n.between(10, 50), "short_text"),
        F.when(F.col("explicit").isNull() & (F.contains(low, F.lit("облигац")) | F.contains(low, F.lit("размещен"))) & (n >= 50), "unresolved"),
    )
    long = j.select("source_key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("category"))
    caps = F.when(F.col("category") == "macro_context", 1200).otherwise(800)
    top = W.top_per_group(long, ["category"], [W.seeded_order(42, "source_key"), F.col("source_key")], 1200).where(F.col("place") <= caps)
    return top.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def functools_or(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def review_groups(spark, d):
    """Mentions by the groups they are reviewed in: explicit and inherited, by level, with and without offering."""
    t = table(spark, d, "telegram_matches", "source_key", "issuer", "entity_level", "match_origin", "offering_id").distinct()
    tests = {"explicit_issuer": "match_origin = 'explicit' AND entity_level = 'issuer'", "explicit_offering": "match_origin = 'explicit' AND entity_level = 'offering'", "inherited": "match_origin = 'inherited'", "with_offering": "offering_id IS NOT NULL", "no_offering": "offering_id IS NULL AND entity_level = 'issuer'"}
    kinds = F.array(*[F.when(F.expr(x), F.lit(k)) for k, x in tests.items()])
    return t.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), "source_key").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_key").alias("texts"))


def ranked_resolution(spark, d):
    """Candidates of a text settled by score: the best one if it leads by 0.12."""
    c = table(spark, d, "telegram_match_candidates", "source_key", "issuer", "match_score").where("issuer is not null").groupBy("source_key", "issuer").agg(F.max("match_score").alias("score"))
    return J.ranked_winner(c, "source_key", "score").select("source_key", "issuer", "score", F.round("lead", 6).alias("lead"))


def explicit_status(spark, d):
    """Texts by what their candidates say: none, resolved or ambiguous, offerings before issuers."""
    c = table(spark, d, "telegram_match_candidates", "source_key", "issuer", "offering_id")
    k = c.groupBy("source_key").agg(F.count_distinct("offering_id").alias("offerings"), F.count_distinct("issuer").alias("issuers"))
    n = F.when(F.col("offerings") > 0, F.col("offerings")).otherwise(F.col("issuers"))
    return k.select("source_key", F.when(n == 0, "none").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("offerings") > 0, "offering").when(F.col("issuers") > 0, "issuer").alias("level"))


def _replies(spark, d):
    m = table(spark, d, "messages", "channel", "id", "parent_id", "text").groupBy("channel", "id").agg(F.min("parent_id").alias("parent_id"), F.min("text").alias("text"))
    key = lambda i: F.concat("channel", F.lit(":"), F.col(i).cast("string"))
    return m.select(key("id").alias("k"), key("parent_id").alias("p"), F.lit(None).cast("timestamp").alias("at"), T.says_little(F.col("text")).alias("short"), F.length("text").alias("chars"), "text")


def _explicit(spark, d):
    t = table(spark, d, "telegram_matches", "source_key", "issuer", "entity_level", "match_origin", "text_len").where("match_origin = 'explicit'")
    return t.groupBy(F.col("source_key").alias("k"), "issuer").agg(F.max("entity_level").alias("level"), (F.max("text_len") / 1000).alias("score")).withColumn("at", F.lit(None).cast("timestamp"))


def scored_inheritance(spark, d):
    """Replies with their parent's score times 0.7, and half of it where they say little."""
    got = J.inherit_scored(_replies(spark, d).drop("chars", "text"), _explicit(spark, d), "k", "p", "at", "short", "score")
    return got.select("k", "anchor", "issuer", "score")


def long_reply_inheritance(spark, d):
    """Inheritance by replies of at least 40 characters only."""
    r = _replies(spark, d).where("chars >= 40").withColumn("short", F.lit(False)).drop("chars", "text")
    return J.inherit_from_parent(r, _explicit(spark, d), "k", "p", "at", "short").select("k", "anchor", "issuer")


def digest_parents(spark, d):
    """Texts too broad to pass on a mention: digests, three issuers or more, or lists of eight lines with two."""
    own = table(spark, d, "telegram_matches", "source_key", "issuer").groupBy(F.col("source_key").alias("k")).agg(F.count_distinct("issuer").alias("issuers"))
    r = _replies(spark, d).join(own, "k")
    marks = F.length("text") - F.length(F.translate("text", "\n•", ""))
    broad = F.lower("text").rlike("дайджест|календарь") | (F.col("issuers") >= 3) | ((marks >= 8) & (F.col("issuers") >= 2))
    return r.select("k", "issuers", F.coalesce(broad, F.lit(False)).alias("broad"))


def regression_folds(spark, d):
    """A line fitted on five of six folds and tested on the other: R2 and RMSE of each fold, from sums."""
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select((F.col("p_partkey") % 6).alias("fold"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return L.line_folds(p, "x", "y", "fold").select(F.col("fold").cast("bigint").alias("fold"), "n", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


def ridge_line(spark, d):
    """Slope and constant of a ridge fit with one regressor, alpha 1000, from sums."""
    p = table(spark, d, "part", "p_size", "p_retailprice")
    return _table(spark, L.ridge(p, ["p_size"], "p_retailprice", 1000.0), "term", "value").select("term", F.round("value", 6).alias("value"))


def residual_tests(spark, d):
    """Mean of the residuals of a line, its t value, and their correlation with the regressor."""
    p = table(spark, d, "part", "p_size", "p_retailprice")
    fit = p.agg(F.regr_slope("p_retailprice", "p_size").alias("b"), F.regr_intercept("p_retailprice", "p_size").alias("a"))
    e = p.crossJoin(F.broadcast(fit)).select((F.col("p_retailprice") - F.col("a") - F.col("b") * F.col("p_size")).alias("e"), "p_size")
    return e.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("e"), 6) + 0.0).alias("mean"), (F.round(F.avg("e") / (F.stddev_samp("e") / F.sqrt(F.count(F.lit(1)))), 6) + 0.0).alias("t"), (F.round(F.corr("e", "p_size"), 6) + 0.0).alias("r"))


def feature_importance(spark, d):
    """Importance of the features of a forest, in percent."""
    return _table(spark, L.importances(_orders(spark, d), ["balance", "price"], "urgent"), "term", "percent")


def cluster_quality(spark, d):
    """Silhouette and Davies-Bouldin index of two and three clusters."""
    return _table(spark, L.cluster_scores(_orders(spark, d), ["balance", "price"], [2, 3]), "term", "value")


def word_vectors(spark, d):
    """Documents as the mean of their words' vectors."""
    docs = table(spark, d, "documents", "doc_id", "text")
    v = L.word_vectors(docs, "doc_id", T.tokens(T.normalize_match_text(F.col("text"))), size=32, epochs=2)
    return v.select("doc_id", F.size("vector").cast("bigint").alias("size"))


_NAMES = """origin_texts first_known sample_sizes baseline_filter varying_columns unique_in_order next_in_order last_car collected_until_known bounded_events training_rows label_scores labelling_sample review_groups
ranked_resolution explicit_status scored_inheritance long_reply_inheritance digest_parents regression_folds ridge_line residual_tests feature_importance cluster_quality word_vectors"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_SHORT = """(norm = '' OR norm IN ('+', '++', 'ага', 'угу', 'ок', 'окей', 'да', 'нет', 'согласен', 'не согласен', 'норм', 'лол', 'жесть', 'имхо', 'ясно', 'понятно', 'спасибо', 'thanks') OR len(regexp_extract_all(norm, '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')) <= 2)"""
_REPLY = """r AS (SELECT channel || ':' || id k, channel || ':' || parent_id p, text, length(text) chars, trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё—–', 'е--'), '[^a-zа-я0-9.-]+', ' ', 'g')) norm FROM (SELECT channel, id, min(parent_id) parent_id, min(text) AS text FROM messages GROUP BY ALL)),
    e AS (SELECT source_key k, issuer, max(entity_level) AS level, max(text_len) / 1000.0 AS score FROM telegram_matches WHERE match_origin = 'explicit' GROUP BY ALL), v AS (SELECT k, max(level = 'offering') off FROM e GROUP BY 1)"""
ORACLE = {
    "origin_texts": "SELECT issuer, count(*) FILTER (match_origin = 'explicit') explicit_rows, count(*) FILTER (match_origin = 'inherited') inherited_rows, count(DISTINCT CASE WHEN match_origin = 'explicit' THEN source_key END) explicit_texts, count(DISTINCT CASE WHEN match_origin = 'inherited' THEN source_key END) inherited_texts, round(avg(text_len), 6) mean_len FROM telegram_matches GROUP BY 1",
    "first_known": "SELECT c_mktsegment, arg_min(c_acctbal, c_custkey) FILTER (c_acctbal > 0) AS first, arg_max(c_acctbal, c_custkey) FILTER (c_acctbal > 0) AS last FROM customer GROUP BY 1",
    "sample_sizes": "SELECT l::BIGINT AS least, s AS sample, count(*) n, count(DISTINCT o_custkey) clusters FROM orders, (VALUES (0), (50000), (100000), (200000)) t(l), (VALUES ('all', NULL), ('fixed', 'F'), ('open', 'O')) u(s, k) WHERE o_totalprice >= l AND (k IS NULL OR o_orderstatus = k) GROUP BY ALL",
    "baseline_filter": "SELECT l_returnflag, count(*) n FROM lineitem WHERE l_quantity > 5 AND l_discount <= 0.08 AND l_tax >= 0.02 GROUP BY 1",
    "varying_columns": """SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) > 1 AS varies FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) > 1 FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) > 1 FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) > 1 FROM lineitem WHERE l_linestatus = 'F'""",
    "unique_in_order": "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY f) priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) f FROM orders GROUP BY ALL) GROUP BY 1",
    "next_in_order": "SELECT channel, id, lead(id) OVER (PARTITION BY channel ORDER BY id) next_id FROM (SELECT DISTINCT channel, id FROM messages)",
    "last_car": "WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_extendedprice) p FROM lineitem GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) r FROM l QUALIFY r <= 30) SELECT l_suppkey, round(sum(p), 2) car, max(r) AS last FROM t GROUP BY 1",
    "collected_until_known": """WITH m AS (SELECT channel, id, id % 5 < 2 known FROM (SELECT DISTINCT channel, id FROM messages)), t AS (SELECT *, known AND coalesce(lag(known, 1) OVER w, false) AND coalesce(lag(known, 2) OVER w, false) three FROM m WINDOW w AS (PARTITION BY channel ORDER BY id DESC)), s AS (SELECT channel, max(id) FILTER (three) stop FROM t GROUP BY 1)
        SELECT channel, count(*) added FROM m JOIN s USING (channel) WHERE NOT known AND (stop IS NULL OR id > stop) GROUP BY 1""",
    "bounded_events": "SELECT event_type, count(*) n FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1",
    "training_rows": """WITH e AS (SELECT *, (item_id % 21) / 20.0 c FROM eval_items WHERE length(text) > 10 AND relevance_to_placement IN ('yes', 'no') AND sentiment IN ('positive', 'negative', 'neutral'))
        SELECT item_id, 'relevance' task, relevance_to_placement AS label FROM e WHERE c >= 0.8 UNION ALL SELECT item_id, 'sentiment', sentiment FROM e WHERE c >= 0.9 AND relevance_to_placement = 'yes'""",
    "label_scores": "SELECT DISTINCT l_orderkey, l_linenumber, round(greatest(l_discount * 4, 1 - l_discount * 4 - l_tax * 5, l_tax * 5), 6) confidence, round(l_tax * 5 - l_discount * 4, 4) score FROM lineitem",
    "labelling_sample": """WITH m AS (SELECT channel || ':' || id k, min(text) AS text FROM messages GROUP BY channel, id), t AS (SELECT source_key k, bool_or(match_origin = 'explicit') x FROM telegram_matches GROUP BY 1), j AS (SELECT m.k, lower(text) low, length(text) n, x FROM m LEFT JOIN t USING (k)),
        c AS (SELECT 'macro_context' category, 1200 cap FROM j WHERE x IS NOT NULL AND regexp_matches(low, 'офз|ставк|ключев|инфляц|цб ') AND n >= 50 UNION ALL SELECT 'short_text', 800 FROM j WHERE x AND n BETWEEN 10 AND 50 UNION ALL SELECT 'unresolved', 800 FROM j WHERE x IS NULL AND regexp_matches(low, 'облигац|размещен') AND n >= 50)
        SELECT category, least(count(*), max(cap)) n FROM c GROUP BY 1""",
    "review_groups": """WITH t AS (SELECT DISTINCT source_key, issuer, entity_level, match_origin, offering_id FROM telegram_matches), k AS (SELECT 'explicit_issuer' kind, source_key FROM t WHERE match_origin = 'explicit' AND entity_level = 'issuer' UNION ALL SELECT 'explicit_offering', source_key FROM t WHERE match_origin = 'explicit' AND entity_level = 'offering'
        UNION ALL SELECT 'inherited', source_key FROM t WHERE match_origin = 'inherited' UNION ALL SELECT 'with_offering', source_key FROM t WHERE offering_id IS NOT NULL UNION ALL SELECT 'no_offering', source_key FROM t WHERE offering_id IS NULL AND entity_level = 'issuer') SELECT kind, count(*) n, count(DISTINCT source_key) texts FROM k GROUP BY 1""",
    "ranked_resolution": """WITH c AS (SELECT source_key, issuer, max(match_score) score FROM telegram_match_candidates WHERE issuer IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER w n, score - lead(score) OVER w AS lead FROM c WINDOW w AS (PARTITION BY source_key ORDER BY score DESC, issuer))
        SELECT source_key, issuer, score, round(lead, 6) AS lead FROM r WHERE n = 1 AND (lead IS NULL OR lead >= 0.12)""",
    "explicit_status": """SELECT source_key, CASE CASE WHEN o > 0 THEN o ELSE i END WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END status, CASE WHEN o > 0 THEN 'offering' WHEN i > 0 THEN 'issuer' END AS level FROM (SELECT source_key, count(DISTINCT offering_id) o, count(DISTINCT issuer) i FROM telegram_match_candidates GROUP BY 1)""",
    "scored_inheritance": f"""WITH {_REPLY} SELECT r.k, e.k anchor, e.issuer, round(e.score * CASE WHEN {_SHORT} THEN 0.35 ELSE 0.7 END, 4)::DOUBLE AS score FROM r JOIN e ON r.p = e.k JOIN v ON v.k = e.k WHERE r.k NOT IN (SELECT k FROM e) AND (NOT {_SHORT} OR v.off)""",
    "long_reply_inheritance": f"""WITH {_REPLY} SELECT r.k, e.k anchor, e.issuer FROM r JOIN e ON r.p = e.k WHERE r.k NOT IN (SELECT k FROM e) AND chars >= 40""",
    "digest_parents": f"""WITH {_REPLY}, o AS (SELECT source_key k, count(DISTINCT issuer) issuers FROM telegram_matches GROUP BY 1) SELECT k, issuers, coalesce(regexp_matches(lower(text), 'дайджест|календарь') OR issuers >= 3 OR (length(text) - length(translate(text, chr(10) || '•', '')) >= 8 AND issuers >= 2), false) broad FROM r JOIN o USING (k)""",
    "regression_folds": """WITH p AS (SELECT p_partkey % 6 AS fold, p_size::DOUBLE x, p_retailprice y FROM part), f AS (SELECT DISTINCT fold FROM p), c AS (SELECT f.fold, regr_slope(y, x) b, regr_intercept(y, x) a FROM f JOIN p ON p.fold <> f.fold GROUP BY 1)
        SELECT fold, count(*) n, round(sqrt(avg((y - a - b * x) ** 2)), 6) rmse, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 6) r2 FROM p JOIN c USING (fold) GROUP BY fold""",
    "ridge_line": "WITH s AS (SELECT covar_pop(p_size, p_retailprice) * count(*) / (var_pop(p_size) * count(*) + 1000) b, avg(p_size) mx, avg(p_retailprice) my FROM part) SELECT 'p_size' term, round(b, 6) AS value FROM s UNION ALL SELECT 'const', round(my - b * mx, 6) FROM s",
    "residual_tests": """WITH f AS (SELECT regr_slope(p_retailprice, p_size) b, regr_intercept(p_retailprice, p_size) a FROM part), e AS (SELECT p_retailprice - a - b * p_size e, p_size FROM part, f) SELECT count(*) n, round(avg(e), 6) + 0 AS mean, round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 6) + 0 AS t, round(corr(e, p_size), 6) + 0 AS r FROM e""",
}
