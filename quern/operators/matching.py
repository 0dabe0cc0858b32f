"""Alias matching in texts: longest match with consumed positions, rows of hits, alias mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ngrams, normalize_match_text, normalize_mining_text, squeeze, tokens
from quern.scale import checked_broadcast

MOST_WORDS = 5


def alias_table(aliases: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(gram, words, issuer, alias, alias_type, risk_flag): aliases as they are looked up; empty and over-long ones are left out.

    A missing risk counts as low. A short alias (under 4 characters, no Latin letter or digit) of medium or high risk is never
    taken, and as such an alias does not consume its words either, it is left out here.
    """
    norm = squeeze(normalize_match_text(F.col("alias")))
    out = aliases.where("issuer is not null and alias is not null").select("issuer", "alias", "alias_type", F.coalesce("risk_flag", F.lit("low")).alias("risk_flag"), norm.alias("gram"), F.size(F.split(norm, " ")).alias("words"))
    risky = F.col("risk_flag").isin("medium", "high") & (F.length("gram") < 4) & ~F.col("gram").rlike("[a-z0-9]")
    return out.where((F.col("gram") != "") & (F.col("words") <= most_words) & ~risky).distinct()


def match_aliases(texts: DataFrame, key: str, text: str, aliases: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, gram, first, words): aliases found in each text, the longest first, none over words already taken.

    Grams of the texts are looked up by an equi-join with the aliases; what overlaps is settled by a fold over the few hits of
    a text, longest first, then leftmost. Null texts have no hits; repeated keys are matched row by row and their hits put together.
    """
    lookup = alias_table(aliases, most_words).select("gram").distinct()
    toks = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), tokens(normalize_match_text(F.col(text))).alias("__t"))

    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size("__t") - n), lambda i: F.struct(F.concat_ws(" ", F.slice("__t", i + 1, n)).alias("gram"), i.alias("first"), F.lit(n).alias("words")))
        return F.when(F.size("__t") >= n, found).otherwise(F.array().cast("array<struct<gram:string,first:int,words:int>>"))

    places = F.flatten(F.array(*[of(n) for n in range(1, most_words + 1)]))
    grams = toks.select("__key", "__row", F.explode(places).alias("p")).select("__key", "__row", "p.*")
    hits = grams.join(checked_broadcast(lookup), "gram")
    order = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("neg"), F.col("first"), F.col("gram"), F.col("words"))))
    per = hits.groupBy("__key", "__row").agg(order.alias("__h"))
    zero = F.array().cast("array<struct<gram:string,first:int,words:int>>")

    def take(acc, h):
        free = ~F.exists(acc, lambda a: (a["first"] < h["first"] + h["words"]) & (h["first"] < a["first"] + a["words"]))
        return F.when(free, F.concat(acc, F.array(F.struct(h["gram"].alias("gram"), h["first"].alias("first"), h["words"].alias("words"))))).otherwise(acc)

    kept = per.select("__key", F.explode(F.aggregate("__h", zero, take)).alias("h"))
    return kept.select(F.col("__key").alias(key), "h.gram", "h.first", "h.words")


def entity_hits(texts: DataFrame, key: str, text: str, aliases: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, issuer, aliases, alias_types): a row per text and issuer, with the sorted aliases it is named by."""
    hits = match_aliases(texts, key, text, aliases, most_words)
    named = hits.join(checked_broadcast(alias_table(aliases, most_words)), ["gram", "words"])
    return named.groupBy(key, "issuer").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("alias_type")).alias("alias_types"))


def resolution(hits: DataFrame, key: str) -> DataFrame:
    """(key, issuers, status): whether a text names one issuer (resolved) or several (ambiguous)."""
    n = F.count_distinct("issuer")
    return hits.groupBy(key).agg(n.alias("issuers")).withColumn("status", F.when(F.col("issuers") == 1, "resolved").otherwise("ambiguous"))


def suppress_issuer_rows(rows: DataFrame, key: str) -> DataFrame:
    """Issuer-level rows fall where an offering-level row of the same text and issuer exists."""
    offering = rows.where("level = 'offering'").select(key, "issuer").distinct()
    return rows.where("level = 'offering'").unionByName(rows.where("level <> 'offering'").join(offering, [key, "issuer"], "left_anti"))


def mine_aliases(texts: DataFrame, group: str, text: str, low: int = 1, high: int = 3, least_in: int = 4, most_out: int = 3, top: int = 25) -> DataFrame:
    """(group, gram, docs_in, docs_out, score, place): grams frequent in a group's texts and rare in all others.

    score = in / (1 + out) * ln(1 + in). Grams of a text count once. Counts are over all texts; what lies outside is the total less the own.
    """
    toks = texts.where(F.col(group).isNotNull()).select(F.col(group), tokens(normalize_mining_text(F.col(text))).alias("__t"))
    grams = toks.select(F.col(group), F.explode(F.array_distinct(ngrams(F.col("__t"), low, high))).alias("gram"))
    grams = grams.where((F.length("gram") >= 3) & ~F.col("gram").rlike(r"^[0-9 .-]+$"))
    own = grams.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("docs_in"))
    total = own.groupBy("gram").agg(F.sum("docs_in").alias("__all"))
    out = own.where(F.col("docs_in") >= least_in).join(total, "gram").withColumn("docs_out", F.col("__all") - F.col("docs_in")).where(F.col("docs_out") <= most_out)
    out = out.withColumn("score", F.col("docs_in") / (1 + F.col("docs_out")) * F.log1p("docs_in"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.desc("docs_in"), "gram")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(group, "gram", "docs_in", "docs_out", "score", "place")


def alias_ambiguity(rows: DataFrame, aliases_json: Column, issuer: str) -> DataFrame:
    """(alias, n, issuers): how often each alias of JSON lists occurs and for how many issuers."""
    from quern.functions.values import json_strings

    return rows.select(F.col(issuer).alias("__i"), F.explode(json_strings(aliases_json)).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__i").alias("issuers"))
