"""Joins, merges, aggregations, windows and sets on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import values as V
from quern.functions.text import says_little
from quern.operators import aggregates as A
from quern.operators import joins as J
from quern.operators import upsert as U
from quern.operators import windows as W
from quern.plans.training import p1_instants
from quern.sources.tables import table


def left_join_metadata(spark, d):
    """Mentions with their message's views, the message's own channel first; duplicate messages once (most views)."""
    t = table(spark, d, "telegram_matches", "source_key", "channel", "message_id", "issuer", "published_at").distinct()
    m = table(spark, d, "messages", "id", "channel", "views", "date").groupBy("channel", F.col("id").alias("message_id")).agg(F.max("views").alias("views"), F.max("date").alias("date_db"))
    j = t.join(m, ["channel", "message_id"], "left")
    return j.groupBy("issuer").agg(F.count(F.lit(1)).alias("n"), F.count("views").alias("with_views"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.count(F.coalesce("date_db", "published_at")).alias("dated"))


def normalized_key_join(spark, d):
    a = table(spark, d, "issuer_aliases", "issuer", "alias")
    s = table(spark, d, "searches", "id", "emitent_name")
    key = lambda c: F.lower(F.trim(c))
    return s.join(a.select("issuer", key("alias").alias("k")).distinct(), key("emitent_name") == F.col("k")).select("id", "issuer")


def rating_asof(spark, d):
    """The last urgent order before each other order of a customer, else the first one after."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    hist = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("rated_at"), F.col("o_totalprice").alias("rating"), F.col("o_orderkey").alias("seq"))
    targets = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
    return J.asof_join(targets, hist, "o_custkey", "o_orderdate", "rated_at", ["rating"], fallback=True, order="seq").select("o_orderkey", "rating", F.col("asof_rated_at").alias("rated_at"), "asof_side")


def rating_asof_active(spark, d):
    """As before, withdrawn rows (returned orders) left out where the customer has any other; no fallback."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    hist = o.where("o_orderpriority = '1-URGENT'")
    active = hist.groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") != "F").cast("int")).alias("any_active"))
    hist = hist.join(active, "o_custkey").where("any_active = 0 or o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderdate").alias("rated_at"), F.col("o_totalprice").alias("rating"), F.col("o_orderkey").alias("seq"))
    targets = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
    return J.asof_join(targets, hist, "o_custkey", "o_orderdate", "rated_at", ["rating"], order="seq").select("o_orderkey", "rating", "asof_side")


def next_trading_date(spark, d):
    """The first day from an order's date on which anything was shipped by supplier 1."""
    cal = table(spark, d, "lineitem", "l_shipdate", "l_suppkey").where("l_suppkey = 1").select(F.to_date("l_shipdate").alias("day"))
    ev = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return J.next_in_calendar(ev, cal, "d", "day").select("o_orderkey", "next_day")


def key_fallback(spark, d):
    """A customer's contact: supplier of the same key, else the least supplier of its nation, else none; with the place it came from."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name")
    first = s.select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    second = s.select(F.col("s_nationkey").alias("c_nationkey"), "s_name")
    return J.fallback_lookup(c, [(first, ["c_custkey"]), (second, ["c_nationkey"])], "s_name", "contact").select("c_custkey", "contact", "contact_from")


def month_phase(spark, d):
    """Lines within the month before an order's date (pre), the week after (post), or outside."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day, ref = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    phase = F.when(day.between(V.month_before(ref), ref), "pre").when(day.between(ref, F.date_add(ref, 7)), "post").otherwise("outside")
    return j.groupBy(phase.alias("phase"), F.year(ref).cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def three_way_concat(spark, d):
    """Per order its lines' distinct brands, sorted; parts may be missing."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    l = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, d, "part", "p_partkey", "p_brand")
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("o_orderkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.count(F.lit(1)).alias("n"))


def _inherited(spark, d, instants=None):
    m = table(spark, d, "messages", "id", "channel", "parent_id", "text").dropDuplicates(["id", "channel"])
    key = lambda i: F.concat("channel", F.lit(":"), F.col(i).cast("string"))
    replies = m.select(key("id").alias("k"), key("parent_id").alias("p"), says_little(F.col("text")).alias("short"))
    own = table(spark, d, "telegram_matches", "source_key", "issuer", "entity_level", "match_origin").where("match_origin = 'explicit'").select(F.col("source_key").alias("k"), F.col("entity_level").alias("level"), "issuer").distinct()
    dated = lambda rows: rows.join(instants, "k", "left") if instants is not None else rows.withColumn("at", F.lit(None).cast("timestamp"))
    return J.inherit_from_parent(dated(replies), dated(own), "k", "p", "at", "short").select("k", "anchor", "issuer", "level")


def thread_inheritance(spark, d):
    """Replies without own mention take over their parent's issuers, however far apart in time (as in the SQL)."""
    return _inherited(spark, d)


def thread_inheritance_timed(spark, d):
    """As before, within 72 hours of the parent; an unknown instant counts as near. Of a message's instants the earliest counts."""
    at = p1_instants(spark, d).where("tbl = 'messages' and utc_us is not null").groupBy(F.col("row_key").alias("k")).agg(F.timestamp_micros(F.min("utc_us")).alias("at"))
    return _inherited(spark, d, at)


def anti_unmatched(spark, d):
    m = table(spark, d, "messages", "id", "channel", "text").where(F.lower("text").rlike("купон|оферт|облигац")).select(F.concat("channel", F.lit(":"), F.col("id").cast("string")).alias("source_key"), "channel").distinct()
    return m.join(table(spark, d, "telegram_matches", "source_key"), "source_key", "left_anti").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def semi_or_nolink(spark, d):
    """Customers without orders, or with an urgent one."""
    c = table(spark, d, "customer", "c_custkey")
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return J.semi_or_unlinked(c, o, "c_custkey", F.col("o_orderpriority") == "1-URGENT")


def best_prefix_match(spark, d):
    s = table(spark, d, "searches", "emitent_name").where("emitent_name is not null").distinct()
    a = table(spark, d, "issuer_aliases", "alias")
    return J.best_match(s, a, "emitent_name", "alias")


def reply_pairs(spark, d):
    """Replies with their parent by channel: lengths and number of replies whose parent was never collected."""
    m = table(spark, d, "messages", "id", "channel", "parent_id", "text").dropDuplicates(["id", "channel"])
    p = m.select(F.col("id").alias("parent_id"), "channel", F.length("text").alias("plen"))
    r = m.where("parent_id is not null").join(p, ["channel", "parent_id"], "left")
    return r.groupBy("channel").agg(F.count(F.lit(1)).alias("replies"), F.count("plen").alias("found"), F.coalesce(F.sum("plen"), F.lit(0)).alias("parent_chars"))


def _versions(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = c.where("c_custkey % 3 <> 0")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("New "), F.col("c_name"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return old, new


def _rounded(df):
    return df.select("c_custkey", "c_name", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


def upsert_coalesce(spark, d):
    return _rounded(U.upsert_coalesce(*_versions(spark, d), ["c_custkey"]))


def insert_ignore(spark, d):
    return _rounded(U.insert_ignore(*_versions(spark, d), ["c_custkey"], [F.col("c_acctbal")]))


def replace_by_key(spark, d):
    return _rounded(U.replace_by_key(*_versions(spark, d), ["c_custkey"]))


def keyed_update(spark, d):
    return _rounded(U.keyed_update(*_versions(spark, d), ["c_custkey"], ["c_name"]))


def earliest_merge(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    f = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return U.earliest_merge(f("F"), f("O"), "o_custkey", "day")


def newest_messages(spark, d):
    """One row a message: the most viewed version."""
    m = table(spark, d, "messages", "id", "channel", "views", "reactions", "reply_count")
    one = U.first_by_key(m, ["id", "channel"], [F.col("views").desc_nulls_last(), F.col("reactions").desc_nulls_last(), F.col("reply_count").desc_nulls_last()])
    return one.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"))


def profile_numeric(spark, d):
    l = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p = A.profile_numeric(l, l.columns)
    return p.select("variable", "n", "missing", *[F.round(c, 4).alias(c) for c in p.columns if c not in ("variable", "n", "missing")])


def category_topn(spark, d):
    docs = table(spark, d, "documents", "lang", "source")
    c = A.category_counts(docs, ["lang", "source"], 10)
    return c.select("variable", "value", "n", F.round("share", 6).alias("share"), F.col("place").cast("bigint").alias("place"))


def crosstab(spark, d):
    return A.crosstab(table(spark, d, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


def agreement_rate(spark, d):
    l = table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    a = l.select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "N").alias("a"), (F.col("l_linestatus") == "O").alias("b"))
    out = A.agreement(a, "a", "b")
    return out.select("n", F.round("agree", 6).alias("agree"))


def char_budget(spark, d):
    """Characters by source over distinct texts, the factor by which repeats blow them up, and a row for all."""
    docs = table(spark, d, "documents", "source", "text").where("source is not null")
    per = docs.groupBy("source", "text").agg(F.count(F.lit(1)).alias("rows")).select("source", F.length("text").alias("chars"), "rows")
    t = A.with_total(per, "source", [F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.round(F.try_divide(F.sum(F.col("chars") * F.col("rows")), F.sum("chars")), 6).alias("factor")])
    return t.withColumn("low_tokens", F.round(F.col("chars") / 4, 2)).withColumn("high_tokens", F.round(F.col("chars") / 2.5, 2))


def having_multi(spark, d):
    l = table(spark, d, "lineitem", "l_partkey", "l_suppkey")
    return l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers")).where("n >= 20 and suppliers >= 2")


def global_stats(spark, d):
    o = table(spark, d, "orders", "o_totalprice")
    x = F.col("o_totalprice")
    return o.agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.sum(x), 2).alias("total"))


def corr_pairs(spark, d):
    l = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return A.correlations(l, l.columns).select("a", "b", F.round("r", 6).alias("r"))


def winsorize(spark, d):
    o = A.winsorize(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"])
    return o.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def iqr_cap(spark, d):
    e = A.cap_outliers(table(spark, d, "events", "event_id", "value"), "value", 0.1, 0.6)
    return e.select("event_id", F.round("value", 6).alias("value"))


def rare_collapse(spark, d):
    return A.collapse_rare(table(spark, d, "customer", "c_custkey", "c_nationkey").withColumn("nation", F.col("c_nationkey").cast("string")), "nation", 60).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


def demean_within_year(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("year", F.year("o_orderdate").cast("bigint"))
    return W.demean(o, ["o_totalprice"], "year").select("o_orderkey", "year", F.round("o_totalprice_dm", 4).alias("dm"))


def topk_per_group(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return W.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("place").cast("bigint").alias("place"))


def running_total(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return W.cumulative(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "total").select("o_orderkey", F.round("total", 2).alias("total"))


def ecdf(spark, d):
    return W.ecdf(table(spark, d, "events", "value"), "value").select("value", "n", F.round("cdf", 9).alias("cdf"))


def z_scores(spark, d):
    e = W.z_scores(table(spark, d, "events", "event_id", "value"), ["value"])
    return e.select("event_id", F.round("value_z", 6).alias("z"))


def expanding_folds(spark, d):
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice").withColumn("year", F.year("o_orderdate").cast("bigint"))
    return W.year_folds(o, "year", 1998, 2001).groupBy(F.col("test_year").cast("bigint").alias("test_year"), "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def rolling_folds(spark, d):
    o = table(spark, d, "orders", "o_orderdate").withColumn("year", F.year("o_orderdate").cast("bigint"))
    return W.year_folds(o, "year", 1998, 2001, 2).groupBy(F.col("test_year").cast("bigint").alias("test_year"), "part").agg(F.count(F.lit(1)).alias("n"))


def status_runs(spark, d):
    """Stretches of equal event types of a user in time."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    r = W.runs(e, ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id").agg(F.max("run").alias("runs"), F.count(F.lit(1)).alias("n"))


def set_difference(spark, d):
    o = table(spark, d, "orders", "o_custkey").distinct()
    c = table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("o_custkey"))
    return c.exceptAll(o).withColumn("side", F.lit("only_customers")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))


def seeded_sample(spark, d):
    return W.seeded_sample(table(spark, d, "documents", "doc_id", "lang"), ["doc_id"], 20, 7, ["lang"])


def stratified_split(spark, d):
    return W.stratified_split(table(spark, d, "documents", "doc_id", "lang"), ["doc_id"], "lang", 0.2, 7).groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


def greedy_batches(spark, d):
    """Lines of an order in batches of at most 3 lines and 60 units."""
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return W.greedy_batches(l, "l_orderkey", "l_linenumber", "l_quantity", 3, 60).groupBy("l_orderkey").agg((F.max("batch") + 1).alias("batches"), F.count(F.lit(1)).alias("lines"))


def leap_and_era(spark, d):
    n = table(spark, d, "nation", "n_nationkey").select((F.col("n_nationkey") * 100 - 400).cast("bigint").alias("y"))
    return n.select("y", V.leap_year(F.col("y")).alias("leap"), V.era(F.col("y")).alias("era"))


def cross_rate(spark, d):
    """Price ratio of part sizes to the base size 1 (its own ratio is one)."""
    p = table(spark, d, "part", "p_size", "p_retailprice").groupBy("p_size").agg(F.avg("p_retailprice").alias("rate"))
    base = p.where("p_size = 1").select(F.col("rate").alias("base"))
    return p.crossJoin(F.broadcast(base)).select(F.col("p_size").cast("bigint").alias("p_size"), F.round(F.when(F.col("p_size") == 1, F.lit(1.0)).otherwise(F.col("rate") / F.col("base")), 6).alias("ratio"))


def json_props(spark, d):
    e = table(spark, d, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def reaction_counts(spark, d):
    """Reactions by kind from the JSON maps; unreadable ones count as empty."""
    m = table(spark, d, "messages", "channel", "reactions_detail")
    kv = m.select("channel", F.explode(F.from_json("reactions_detail", "map<string,bigint>")).alias("kind", "n"))
    return kv.groupBy("channel", "kind").agg(F.sum("n").alias("n"))


def quality_report(spark, d):
    """One row a rule: how many rows break it."""
    m = table(spark, d, "messages", "views", "date", "parent_id", "text")
    rules = {"missing views": F.col("views").isNull(), "missing date": F.col("date").isNull(), "negative views": F.col("views") < 0, "short text": F.length("text") <= 3, "is a reply": F.col("parent_id").isNotNull()}
    one = m.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("n")) for i, k in enumerate(rules)])).alias("x")).select("x.*")


_NAMES = """left_join_metadata normalized_key_join rating_asof rating_asof_active next_trading_date key_fallback month_phase three_way_concat thread_inheritance thread_inheritance_timed anti_unmatched semi_or_nolink best_prefix_match
reply_pairs upsert_coalesce insert_ignore replace_by_key keyed_update earliest_merge newest_messages profile_numeric category_topn crosstab agreement_rate char_budget having_multi global_stats corr_pairs winsorize
iqr_cap rare_collapse demean_within_year topk_per_group running_total ecdf z_scores expanding_folds rolling_folds status_runs set_difference seeded_sample stratified_split greedy_batches leap_and_era cross_rate json_props
reaction_counts quality_report"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_OLD_NEW = """o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'New ' || c_name END c_name, c_acctbal + 1 c_acctbal, NULL::VARCHAR c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"""
_MD = "(SELECT DISTINCT ON (id, channel) id, channel, parent_id, text FROM messages)"
ORACLE = {
    "left_join_metadata": """WITH t AS (SELECT DISTINCT source_key, channel, message_id, issuer, published_at FROM telegram_matches), m AS (SELECT channel, id message_id, max(views) views, max(date) date_db FROM messages GROUP BY ALL)
        SELECT issuer, count(*) n, count(views) with_views, coalesce(sum(views), 0)::BIGINT views, count(coalesce(date_db, published_at)) dated FROM t LEFT JOIN m USING (channel, message_id) GROUP BY issuer""",
    "normalized_key_join": "SELECT s.id, a.issuer FROM searches s JOIN (SELECT DISTINCT issuer, lower(trim(alias)) k FROM issuer_aliases) a ON lower(trim(s.emitent_name)) = a.k",
    "rating_asof": """WITH h AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
        b AS (SELECT t.o_orderkey, max((h.o_orderdate, h.o_orderkey, h.o_totalprice)) FILTER (h.o_orderdate <= t.o_orderdate) x, min((h.o_orderdate, h.o_orderkey, h.o_totalprice)) FILTER (h.o_orderdate > t.o_orderdate) y
            FROM t LEFT JOIN h USING (o_custkey) GROUP BY t.o_orderkey)
        SELECT o_orderkey, coalesce(x[3], y[3]) rating, coalesce(x[1], y[1]) rated_at, CASE WHEN x IS NOT NULL THEN 'before' WHEN y IS NOT NULL THEN 'after' END asof_side FROM b""",
    "rating_asof_active": """WITH h AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY o_orderstatus <> 'F' OR count(*) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey) = 0), t AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
        b AS (SELECT t.o_orderkey, max((h.o_orderdate, h.o_orderkey, h.o_totalprice)) FILTER (h.o_orderdate <= t.o_orderdate) x FROM t LEFT JOIN h USING (o_custkey) GROUP BY t.o_orderkey)
        SELECT o_orderkey, x[3] rating, CASE WHEN x IS NOT NULL THEN 'before' END asof_side FROM b""",
    "next_trading_date": """WITH c AS (SELECT DISTINCT l_shipdate::DATE dday FROM lineitem WHERE l_suppkey = 1)
        SELECT o_orderkey, (SELECT min(dday) FROM c WHERE dday >= o_orderdate::DATE) next_day FROM orders""",
    "key_fallback": """SELECT c_custkey, coalesce(a.s_name, b.s_name) contact, CASE WHEN a.s_name IS NOT NULL THEN 1 WHEN b.s_name IS NOT NULL THEN 2 END contact_from FROM customer
        LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN (SELECT s_nationkey, min(s_name) s_name FROM supplier GROUP BY 1) b ON b.s_nationkey = c_nationkey""",
    "month_phase": """SELECT CASE WHEN l_shipdate::DATE BETWEEN o_orderdate::DATE - INTERVAL 1 MONTH AND o_orderdate::DATE THEN 'pre' WHEN l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + INTERVAL 7 DAY THEN 'post' ELSE 'outside' END phase,
        year(o_orderdate) AS year, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "three_way_concat": """SELECT o_orderkey, o_orderstatus, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') brands, count(*) n FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "thread_inheritance": f"""WITH m AS (SELECT channel || ':' || id k, channel || ':' || parent_id p, trim(regexp_replace(translate(lower(text), 'ё—–', 'е--'), '[^a-zа-я0-9.-]+', ' ', 'g')) t FROM {_MD}),
        r AS (SELECT k, p, len(regexp_extract_all(t, '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')) <= 2 OR t IN ('ага', 'угу', 'ок', 'окей', 'да', 'нет', 'согласен', 'не согласен', 'норм', 'лол', 'жесть', 'имхо', 'ясно', 'понятно', 'спасибо', 'thanks') short FROM m WHERE p IS NOT NULL),
        o AS (SELECT DISTINCT source_key k, entity_level AS level, issuer FROM telegram_matches WHERE match_origin = 'explicit')
        SELECT r.k, o.k AS anchor, o.issuer, o.level FROM r JOIN o ON r.p = o.k WHERE r.k NOT IN (SELECT k FROM o) AND (NOT short OR r.p IN (SELECT k FROM o WHERE level = 'offering'))""",
    "reaction_counts": """WITH k AS (SELECT channel, reactions_detail j, unnest(json_keys(reactions_detail)) kind FROM messages WHERE reactions_detail <> '' AND json_valid(reactions_detail))
        SELECT channel, kind, sum(CAST(json_extract(j, '$."' || kind || '"') AS BIGINT))::BIGINT n FROM k GROUP BY ALL""",
    "anti_unmatched": """SELECT channel, count(*) n FROM (SELECT DISTINCT channel || ':' || id k, channel FROM messages WHERE regexp_matches(lower(text), 'купон|оферт|облигац')) WHERE k NOT IN (SELECT source_key FROM telegram_matches WHERE source_key IS NOT NULL) GROUP BY channel""",
    "semi_or_nolink": """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "best_prefix_match": """WITH s AS (SELECT DISTINCT emitent_name, lower(trim(emitent_name)) q FROM searches WHERE emitent_name IS NOT NULL), a AS (SELECT DISTINCT alias, lower(trim(alias)) i FROM issuer_aliases WHERE alias IS NOT NULL),
        p AS (SELECT emitent_name, alias, CASE WHEN i = q THEN 0 WHEN starts_with(i, q) THEN 1 WHEN starts_with(q, i) THEN 2 END r FROM s JOIN a ON left(q, 3) = left(i, 3)),
        b AS (SELECT emitent_name, min((r, alias)) FILTER (r IS NOT NULL) x FROM p GROUP BY 1)
        SELECT s.emitent_name, x[2] AS match, x[1] AS match_rank FROM s LEFT JOIN b USING (emitent_name)""",
    "reply_pairs": f"""SELECT r.channel, count(*) replies, count(p.id) found, coalesce(sum(length(p.text)), 0)::BIGINT parent_chars FROM {_MD} r LEFT JOIN {_MD} p ON p.channel = r.channel AND p.id = r.parent_id WHERE r.parent_id IS NOT NULL GROUP BY 1""",
    "upsert_coalesce": f"WITH {_OLD_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) c_custkey, coalesce(n.c_name, o.c_name) c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 4) c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey",
    "insert_ignore": f"WITH {_OLD_NEW} SELECT c_custkey, c_name, round(c_acctbal, 4) c_acctbal, c_mktsegment FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o))",
    "replace_by_key": f"WITH {_OLD_NEW} SELECT c_custkey, c_name, round(c_acctbal, 4) c_acctbal, c_mktsegment FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n))",
    "keyed_update": f"WITH {_OLD_NEW} SELECT o.c_custkey, coalesce(n.c_name, o.c_name) c_name, round(o.c_acctbal, 4) c_acctbal, o.c_mktsegment FROM o LEFT JOIN n USING (c_custkey)",
    "earliest_merge": """WITH a AS (SELECT o_custkey, min(o_orderdate)::DATE x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, min(o_orderdate)::DATE y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT o_custkey, least(x, y) AS day, CASE WHEN x IS NULL THEN 'new' WHEN y < x THEN 'moved' ELSE 'kept' END AS action FROM a FULL JOIN b USING (o_custkey)""",
    "newest_messages": "SELECT channel, count(*) n, coalesce(sum(v), 0)::BIGINT views FROM (SELECT id, channel, max(views) v FROM messages GROUP BY ALL) GROUP BY channel",
    "greedy_batches": """WITH RECURSIVE l AS (SELECT l_orderkey, l_quantity::BIGINT q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) r FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) l_quantity FROM lineitem GROUP BY ALL)),
        f AS (SELECT l_orderkey, r, 0::BIGINT b, 1 n, q s FROM l WHERE r = 1 UNION ALL SELECT l.l_orderkey, l.r, CASE WHEN n < 3 AND s + q <= 60 THEN b ELSE b + 1 END, CASE WHEN n < 3 AND s + q <= 60 THEN n + 1 ELSE 1 END, CASE WHEN n < 3 AND s + q <= 60 THEN s + q ELSE q END FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.r = f.r + 1)
        SELECT l_orderkey, max(b) + 1 AS batches, count(*) AS lines FROM f GROUP BY 1""",
    "profile_numeric": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) n, count(*) FILTER ({c} IS NULL) missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.01), 4) p01, round(quantile_cont({c}, 0.05), 4) p05, round(quantile_cont({c}, 0.25), 4) p25,
        round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) p75, round(quantile_cont({c}, 0.95), 4) p95, round(quantile_cont({c}, 0.99), 4) p99, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")",
    "category_topn": """WITH u AS (SELECT 'lang' AS variable, coalesce(lang, 'Missing') AS value FROM documents UNION ALL SELECT 'source', coalesce(source, 'Missing') FROM documents), c AS (SELECT variable, value, count(*) n FROM u GROUP BY ALL)
        SELECT variable, value, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS share, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS place FROM c QUALIFY place <= 10""",
    "crosstab": "SELECT coalesce(o_orderstatus, 'Missing') o_orderstatus, coalesce(o_orderpriority, 'Missing') o_orderpriority, count(*) n FROM orders GROUP BY ALL",
    "agreement_rate": "SELECT count(*) n, round(avg(CASE WHEN (l_returnflag = 'N') = (l_linestatus = 'O') THEN 1.0 ELSE 0.0 END), 6) agree FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus IS NOT NULL",
    "char_budget": """WITH p AS (SELECT source, text, length(text) chars, count(*) AS nrows FROM documents WHERE source IS NOT NULL GROUP BY ALL)
        SELECT coalesce(source, 'TOTAL') AS source, count(*) texts, sum(chars)::BIGINT chars, round(sum(chars * nrows) / nullif(sum(chars), 0), 6) factor, round(sum(chars) / 4, 2) low_tokens, round(sum(chars) / 2.5, 2)::DOUBLE high_tokens FROM p GROUP BY ROLLUP (source)""",
    "having_multi": "SELECT l_partkey, count(*) n, count(DISTINCT l_suppkey) suppliers FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT l_suppkey) >= 2",
    "global_stats": "SELECT count(o_totalprice) n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) std, min(o_totalprice) low, max(o_totalprice) high, round(sum(o_totalprice), 2) total FROM orders",
    "corr_pairs": " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
    "winsorize": "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) a, quantile_cont(o_totalprice, 0.99) b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 4) o_totalprice FROM orders, q",
    "iqr_cap": "WITH q AS (SELECT quantile_cont(value, 0.1) a, quantile_cont(value, 0.6) b FROM events) SELECT event_id, round(CASE WHEN value > b + 1.5 * (b - a) THEN b WHEN value < a - 1.5 * (b - a) THEN a ELSE value END, 6) AS value FROM events, q",
    "rare_collapse": "WITH c AS (SELECT c_nationkey, count(*) n FROM customer GROUP BY 1) SELECT CASE WHEN n >= 60 THEN c_nationkey::VARCHAR ELSE 'Other' END nation, sum(n)::BIGINT n FROM c GROUP BY 1",
    "demean_within_year": "SELECT o_orderkey, year(o_orderdate) AS year, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY year(o_orderdate)), 4) dm FROM orders",
    "topk_per_group": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3",
    "running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) total FROM orders",
    "ecdf": "SELECT value, count(*) n, round(sum(count(*)) OVER (ORDER BY value) / (SELECT count(value) FROM events), 9) cdf FROM events WHERE value IS NOT NULL GROUP BY value",
    "z_scores": "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) z FROM events",
    "expanding_folds": "SELECT t AS test_year, CASE WHEN year(o_orderdate) = t THEN 'test' ELSE 'train' END AS part, count(*) n, round(avg(o_totalprice), 4) AS mean FROM orders, range(1998, 2002) r(t) WHERE year(o_orderdate) <= t GROUP BY ALL",
    "rolling_folds": "SELECT t AS test_year, CASE WHEN year(o_orderdate) = t THEN 'test' ELSE 'train' END AS part, count(*) n FROM orders, range(1998, 2002) r(t) WHERE year(o_orderdate) BETWEEN t - 2 AND t GROUP BY ALL",
    "status_runs": "SELECT user_id, sum(c)::BIGINT runs, count(*) n FROM (SELECT user_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1",
    "set_difference": "SELECT c_custkey o_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'only_customers' END side FROM customer",
    "stratified_split": "WITH c AS (SELECT lang, count(*) n FROM documents GROUP BY 1) SELECT lang, 'test' AS part, round(n * 0.2)::BIGINT n FROM c WHERE round(n * 0.2) > 0 UNION ALL SELECT lang, 'train', n - round(n * 0.2)::BIGINT FROM c WHERE n > round(n * 0.2)",
    "leap_and_era": "SELECT y, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 leap, CASE WHEN y > 0 THEN 'AD' ELSE 'BC' END era FROM (SELECT n_nationkey::BIGINT * 100 - 400 y FROM nation)",
    "cross_rate": "WITH p AS (SELECT p_size, avg(p_retailprice) r FROM part GROUP BY 1) SELECT p_size::BIGINT p_size, round(CASE WHEN p_size = 1 THEN 1.0::DOUBLE ELSE r / (SELECT r FROM p WHERE p_size = 1) END, 6) ratio FROM p",
    "json_props": "SELECT event_type, count(k) n, sum(k)::BIGINT k_sum, max(k) k_max FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events) GROUP BY 1",
    "quality_report": """SELECT 'missing views' AS rule, count(*) FILTER (views IS NULL) n FROM messages UNION ALL SELECT 'missing date', count(*) FILTER (date IS NULL) FROM messages UNION ALL SELECT 'negative views', count(*) FILTER (views < 0) FROM messages
        UNION ALL SELECT 'short text', count(*) FILTER (length(text) <= 3) FROM messages UNION ALL SELECT 'is a reply', count(*) FILTER (parent_id IS NOT NULL) FROM messages""",
}
