"""Functions of single values and texts on the tables: keys, labels, dates, JSON, cleaning, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import values as V
from quern.operators import vectors as X
from quern.operators.joins import best_match, substring_match
from quern.sources.tables import table

# Words that say little in English and Russian.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with this they but not you we his her их его ее она они оно это эта эти тот та те как так что чтобы если или но не ни да же бы ли уже еще за из от до по при про под над для без в во на с со к ко у о об и а".split()
PERIODS = {"5 дней": 5, "месяц": 30, "год": 365}
CURRENCIES = {"Доллар США": "USD", "Евро": "EUR", "Китайский юань": "CNY", "Российский рубль": "RUB"}


def key_parts(spark, d):
    """Source and local id of a key 'channel:id'."""
    t = table(spark, d, "telegram_matches", "source_key").distinct().withColumn("p", V.key_parts(F.col("source_key")))
    return t.select("source_key", "p.source", "p.local")


def clean_posts(spark, d):
    return table(spark, d, "messages", "channel", "id", "text").distinct().select("channel", "id", T.clean_post(F.col("text")).alias("clean"))


def stop_words_removed(spark, d):
    """Documents without words that say little."""
    toks = T.tokens(T.normalize_match_text(F.col("text")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(T.remove_words(toks, STOP_WORDS), " ").alias("words"))


def aggregate_terms(spark, d):
    """Whether a message speaks of totals or of upper bounds, and the first words that do."""
    m = table(spark, d, "messages", "channel", "id", "text").distinct()
    total = T.pattern_flag(F.col("text"), r"совокуп[а-яё]*|общ[а-яё]*")
    bound = T.pattern_flag(F.col("text"), r"не\s+больше|не\s+более|не\s+превышающ[а-яё]*")
    return m.select("channel", "id", total["flag"].alias("total"), total["first"].alias("total_text"), bound["flag"].alias("bound"), bound["first"].alias("bound_text"))


def context_snippets(spark, d):
    """Messages where coupon and offer stand at most 280 characters apart."""
    m = table(spark, d, "messages", "channel", "id", "text").distinct()
    return m.where(T.near_context(F.col("text"), "купон", "оферт")).select("channel", "id")


def role_evidence(spark, d):
    """Messages whose word 'купон' has a word of placing near: 4 tokens before to 8 behind."""
    m = table(spark, d, "messages", "channel", "id", "text").distinct().withColumn("k", T.tokens(T.normalize_match_text(F.col("text"))))
    m = m.withColumn("at", F.array_position("k", "купон")).where("at > 0")
    return m.select("channel", "id", T.stem_near(F.col("k"), F.col("at") - 1, F.col("at"), ["размест", "размещ", "открыл", "собрал"], 4, 8).alias("near"))


def anchor_windows(spark, d):
    """Six tokens around each listed short name of a document's issuer; its first twelve and six more where it has none."""
    a = table(spark, d, "issuer_aliases", "issuer", "alias", "alias_type").where("alias_type = 'short_name' and issuer is not null")
    a = a.select("issuer", T.tokens(T.normalize_match_text(F.col("alias"))).alias("name")).where(F.size("name") > 0).distinct()
    names = a.groupBy("issuer").agg(F.array_sort(F.collect_set("name")).alias("names"))
    doc = table(spark, d, "documents", "doc_id", "issuer", "text").where("issuer is not null")
    doc = doc.select("doc_id", "issuer", T.tokens(T.normalize_match_text(F.col("text"))).alias("k")).where(F.size("k") > 0).join(names, "issuer", "left")
    at = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.size("k") - 1), lambda i: F.struct(i.alias("i"), (i + F.size(n)).alias("j"))), lambda s: (s["j"] <= F.size("k")) & (F.slice("k", s["i"] + 1, F.size(n)) == n))
    spans = F.array_distinct(F.flatten(F.transform(F.coalesce("names", F.array().cast("array<array<string>>")), at)))
    first = F.array(F.struct(F.lit(0).alias("i"), F.least(F.size("k"), F.lit(12)).alias("j")))
    doc = doc.withColumn("spans", F.when(F.size(spans) > 0, spans).otherwise(first)).select("doc_id", "k", F.explode("spans").alias("s"))
    low, high = F.greatest(F.col("s.i") - 6, F.lit(0)), F.least(F.col("s.j") + 6, F.size("k"))
    return doc.select("doc_id", F.col("s.i").cast("bigint").alias("start"), F.array_join(F.slice("k", low + 1, high - low), " ").alias("window"))


def padded_ids(spark, d):
    """Numbers written with a point as ids of ten digits."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return c.select("c_custkey", V.padded_id(F.col("c_custkey").cast("double")).alias("id"))


def dashed_titles(spark, d):
    p = table(spark, d, "articles", "article_id", "title").distinct()
    return p.select("article_id", V.plain_dashes(F.col("title")).alias("title"))


def relative_times(spark, d):
    """'N minutes (hours) ago', 'just now' and dates in English words, before a fixed moment."""
    p = table(spark, d, "part", "p_partkey", "p_size")
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat("p_size", F.lit(" Minutes ago"))).when(k == 1, F.concat("p_size", F.lit(" hour ago"))).when(k == 2, F.lit("Just now")).otherwise(F.concat(F.lit("Oct 26, 20"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(", 11:56")))
    return p.select("p_partkey", V.time_ago(said, F.lit("2024-03-01 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at"))


def reactions_recovered(spark, d):
    """Reactions of messages from JSON with prose around it; unreadable as null."""
    m = table(spark, d, "messages", "channel", "id", "reactions_detail").distinct()
    wrapped = F.concat(F.lit("Ответ: ```json "), F.col("reactions_detail"), F.lit(" ```"))
    return m.select("channel", "id", V.recovered_json(wrapped, "map<string,int>")["👍"].cast("bigint").alias("likes"), V.recovered_json(F.col("reactions_detail"), "map<string,int>")["👎"].cast("bigint").alias("dislikes"))


def alias_lists(spark, d):
    """The aliases of an issuer over all matches, as sorted JSON."""
    t = table(spark, d, "telegram_matches", "issuer", "matched_aliases").select("issuer", F.explode(V.json_strings(F.col("matched_aliases"))).alias("a"))
    return t.groupBy("issuer").agg(V.sorted_json(F.collect_set("a")).alias("aliases"))


def inherited_share(spark, d):
    """Share of inherited mentions by issuer, in percent."""
    t = table(spark, d, "telegram_matches", "issuer", "match_origin").groupBy("issuer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("match_origin") == "inherited").alias("k"))
    return t.select("issuer", "n", V.percent(F.col("k") / F.col("n")).alias("inherited"))


def period_lengths(spark, d):
    """Days of a named period, currencies looked up by name or by code."""
    p = table(spark, d, "part", "p_partkey")
    k, m = F.col("p_partkey") % 4, F.col("p_partkey") % 6
    period = F.when(k == 0, "5 дней").when(k == 1, "месяц").when(k == 2, "год").otherwise("неделя")
    said = F.when(m == 0, "Евро").when(m == 1, "USD").when(m == 2, "CNY").when(m == 3, "Доллар США").when(m == 4, "руб")
    pairs = spark.createDataFrame(list(CURRENCIES.items()), "name string, code string")
    by = pairs.select(F.explode(F.array("name", "code")).alias("said"), "name", "code")
    out = p.select("p_partkey", V.period_days(period, PERIODS, 4).cast("bigint").alias("days"), said.alias("said"))
    return out.join(F.broadcast(by), "said", "left").select("p_partkey", "days", F.coalesce("code", F.lit("Нет совпадений")).alias("code"), F.coalesce("name", F.lit("Нет совпадений")).alias("name"))


def reviewed_labels(spark, d):
    """Labels in many spellings as 1, 0 or null, clamped scores and enumerations with a default."""
    e = table(spark, d, "eval_items", "item_id", "relevance_to_placement", "sentiment")
    x = F.col("item_id") % 7
    return e.select(
        "item_id", V.label01(F.concat(F.lit(" "), F.upper("relevance_to_placement"))).cast("bigint").alias("label"), V.enum(F.col("sentiment"), ["positive", "negative", "neutral"], "neutral").alias("sentiment"),
        V.clamp01((x - 2) / 4).alias("clamped"), V.non_negative((x - 3).cast("double")).alias("least_zero"), V.evidence((x - 3).cast("double"), x / 40, F.when(x % 2 == 0, "positive").otherwise("negative")).alias("evidence"),
    )


def best_matches(spark, d):
    """Channels and titles of feeds by their closest beginning: names of one and two letters too."""
    f = table(spark, d, "feeds", "feed").where("feed is not null").distinct()
    q = f.select(F.substring("feed", 1, 2).alias("asked")).unionByName(f.select(F.concat("feed", F.lit("-x")).alias("asked"))).distinct()
    return best_match(q, f, "asked", "feed").select("asked", "match", F.col("match_rank").cast("bigint").alias("match_rank"))


def book_periods(spark, d):
    """First and last moment of written periods."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "dd.MM.yyyy")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day(0), F.lit(" (11:00) - "), day(3), F.lit(" 15:30"))).otherwise(day(0))
    p = V.book_period(said)
    return o.select("o_orderkey", p["first"].cast("timestamp_ntz").alias("first"), p["last"].cast("timestamp_ntz").alias("last"), V.hours_between(p["last"], p["first"]).alias("hours"))


def plain_bodies(spark, d):
    """Texts with tags and entities around them as plain text."""
    a = table(spark, d, "articles", "article_id", "title").distinct()
    html = F.concat(F.lit("<div><script>x</script><b>"), F.col("title"), F.lit("</b>&nbsp;&laquo;да&raquo; &amp; <br/>ещё</div>"))
    return a.select("article_id", T.strip_html(html).alias("text"), T.contains_key(F.col("title"), F.lit("банк")).alias("bank"), T.issue_number(F.col("title")).alias("issue"))


def document_tfidf(spark, d):
    """Terms of all documents by weight."""
    w = X.tf_idf(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def document_vocabulary(spark, d):
    """The 1,500 most frequent terms of all documents."""
    return X.vocabulary(table(spark, d, "documents", "text"), "text").select("term", "n", F.col("index").cast("bigint").alias("index"))


def substring_feeds(spark, d):
    """Feeds whose name holds another's last five letters, also within a word."""
    f = table(spark, d, "feeds", "feed").where("feed is not null").distinct()
    ends = f.select(F.expr("right(feed, 5)").alias("part")).distinct()
    return substring_match(ends, f, "part", "feed")


_NAMES = """document_tfidf document_vocabulary substring_feeds key_parts clean_posts stop_words_removed aggregate_terms context_snippets role_evidence anchor_windows padded_ids dashed_titles relative_times reactions_recovered alias_lists inherited_share
period_lengths reviewed_labels best_matches book_periods plain_bodies"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NORM = "trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё—–', 'е--'), '[^a-zа-я0-9.-]+', ' ', 'g'))"
_TOK = f"regexp_extract_all({_NORM}, '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')"
_W, _S = r"\p{L}\p{N}_", r"\s\p{Z}\x{85}"


def _cleaned() -> str:
    s = "lower(text)"
    steps = [(rf"https?://[^{_S}]+|www\.[^{_S}]+", ""), (r"<[^>]+>", ""), (rf"[^{_S}]+@[^{_S}]+", ""), (rf"@[{_W}]+", ""), (rf"#[{_W}]+", ""), (rf"(^|[^{_W}])rt($|[^{_W}])", r"\1\2"), (rf"(^|[^{_W}])rt($|[^{_W}])", r"\1\2"), (r"\p{Nd}+", ""), (rf"[^{_W}{_S}]", " "), (r"[^\x00-\x7F]", ""), (r"\s+", " ")]
    for rx, by in steps:
        s = f"regexp_replace({s}, '{rx}', '{by}', 'g')"
    return f"trim({s})"


ORACLE = {
    "document_tfidf": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')) term FROM documents), f AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL), n AS (SELECT count(*) n FROM documents),
        d AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 idf FROM f, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.9 * n)
        SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) weight FROM f JOIN d USING (term)""",
    "document_vocabulary": "SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 1 AS index FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')) term, count(*) n FROM documents GROUP BY 1 ORDER BY n DESC, term LIMIT 1500)",
    "substring_feeds": "SELECT DISTINCT right(a.feed, 5) part, b.feed FROM feeds a, feeds b WHERE contains(lower(b.feed), lower(right(a.feed, 5))) OR contains(lower(right(a.feed, 5)), lower(b.feed))",
    "key_parts": "SELECT DISTINCT source_key, split_part(source_key, ':', 1) AS source, substr(source_key, strpos(source_key, ':') + 1) AS local FROM telegram_matches",
    "clean_posts": f"SELECT channel, id, {_cleaned()} clean FROM (SELECT DISTINCT channel, id, text FROM messages)",
    "stop_words_removed": f"SELECT doc_id, array_to_string(list_filter({_TOK}, lambda x: x NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})), ' ') words FROM documents",
    "aggregate_terms": r"""SELECT channel, id, t <> '' AS total, nullif(t, '') total_text, b <> '' AS bound, nullif(b, '') bound_text FROM (SELECT channel, id, regexp_extract(coalesce(text, ''), '(?i)(совокуп[а-яёА-ЯЁ]*|общ[а-яёА-ЯЁ]*)', 1) t,
        regexp_extract(coalesce(text, ''), '(?i)(не\s+больше|не\s+более|не\s+превышающ[а-яё]*)', 1) b FROM (SELECT DISTINCT channel, id, text FROM messages))""",
    "context_snippets": r"SELECT channel, id FROM (SELECT DISTINCT channel, id, text FROM messages) WHERE regexp_matches(lower(text), '(?s)купон.{0,280}оферт|оферт.{0,280}купон')",
    "role_evidence": f"""WITH m AS (SELECT channel, id, k, list_position(k, 'купон') p FROM (SELECT channel, id, {_TOK} k FROM (SELECT DISTINCT channel, id, text FROM messages)) WHERE list_contains(k, 'купон'))
        SELECT channel, id, len(list_filter(k[greatest(p - 4, 1):p + 8], lambda t: starts_with(t, 'размест') OR starts_with(t, 'размещ') OR starts_with(t, 'открыл') OR starts_with(t, 'собрал'))) > 0 AS near FROM m""",
    "anchor_windows": f"""WITH a AS (SELECT DISTINCT issuer, {_TOK} AS name FROM (SELECT issuer, alias AS text FROM issuer_aliases WHERE alias_type = 'short_name' AND issuer IS NOT NULL)), d AS (SELECT doc_id, issuer, k FROM (SELECT doc_id, issuer, {_TOK} k FROM documents WHERE issuer IS NOT NULL) WHERE len(k) > 0),
        i AS (SELECT doc_id, issuer, k, unnest(range(1, len(k) + 1)) s FROM d), h AS (SELECT DISTINCT doc_id, k, s, s + len(name) - 1 e FROM i JOIN a USING (issuer) WHERE len(name) > 0 AND k[s] = name[1] AND k[s:s + len(name) - 1] = name),
        f AS (SELECT doc_id, k, 1 s, least(len(k), 12) e FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h)) SELECT doc_id, s::BIGINT - 1 AS start, array_to_string(k[greatest(s - 6, 1):e + 6], ' ') AS "window" FROM (SELECT * FROM h UNION ALL SELECT * FROM f)""",
    "padded_ids": "SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '0') id FROM customer",
    "dashed_titles": "SELECT DISTINCT article_id, trim(translate(title, '–—', '--')) title FROM articles",
    "relative_times": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN TIMESTAMP '2024-03-01 12:00:00' - to_minutes(p_size) WHEN 1 THEN TIMESTAMP '2024-03-01 12:00:00' - to_hours(p_size) WHEN 2 THEN TIMESTAMP '2024-03-01 12:00:00' ELSE make_timestamp(2000 + p_size, 10, 26, 11, 56, 0) END AS at FROM part",
    "reactions_recovered": """SELECT channel, id, try_cast(json_extract_string(try_cast(nullif(trim(reactions_detail), '') AS JSON), '$."👍"') AS BIGINT) likes, try_cast(json_extract_string(try_cast(nullif(trim(reactions_detail), '') AS JSON), '$."👎"') AS BIGINT) dislikes FROM (SELECT DISTINCT channel, id, reactions_detail FROM messages)""",
    "alias_lists": "SELECT issuer, to_json(list_sort(list(DISTINCT alias)))::VARCHAR aliases FROM (SELECT issuer, unnest(from_json(matched_aliases, '[\"VARCHAR\"]')) alias FROM telegram_matches) GROUP BY 1",
    "inherited_share": "SELECT issuer, count(*) n, printf('%.1f', 100.0 * count(*) FILTER (match_origin = 'inherited') / count(*)) || '%' inherited FROM telegram_matches GROUP BY 1",
    "period_lengths": """WITH c(name, code) AS (VALUES ('Доллар США', 'USD'), ('Евро', 'EUR'), ('Китайский юань', 'CNY'), ('Российский рубль', 'RUB')), p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 30 WHEN 2 THEN 365 ELSE 4 END::BIGINT AS days, CASE p_partkey % 6 WHEN 0 THEN 'Евро' WHEN 1 THEN 'USD' WHEN 2 THEN 'CNY' WHEN 3 THEN 'Доллар США' WHEN 4 THEN 'руб' END said FROM part)
        SELECT p_partkey, days, coalesce(code, 'Нет совпадений') code, coalesce(name, 'Нет совпадений') AS name FROM p LEFT JOIN c ON said = name OR said = code""",
    "reviewed_labels": """SELECT item_id, CASE WHEN lower(trim(relevance_to_placement)) IN ('1', 'true', 'yes', 'y', 'correct', 'tp') THEN 1 WHEN lower(trim(relevance_to_placement)) IN ('0', 'false', 'no', 'n', 'incorrect', 'fp') THEN 0 END::BIGINT AS label,
        CASE WHEN sentiment IN ('positive', 'negative', 'neutral') THEN sentiment ELSE 'neutral' END sentiment, least(greatest((x - 2) / 4.0, 0), 1)::DOUBLE clamped, greatest(x - 3, 0)::DOUBLE least_zero,
        CASE WHEN x / 40.0 >= 0.1 THEN 'no evidence' WHEN x % 2 = 0 THEN CASE WHEN x > 3 THEN 'supports' ELSE 'opposite sign' END ELSE CASE WHEN x < 3 THEN 'supports' ELSE 'opposite sign' END END evidence FROM (SELECT *, item_id % 7 AS x FROM eval_items)""",
    "best_matches": """WITH f AS (SELECT DISTINCT feed FROM feeds WHERE feed IS NOT NULL), q AS (SELECT left(feed, 2) asked FROM f UNION SELECT feed || '-x' FROM f), p AS (SELECT asked, feed AS match, CASE WHEN lower(trim(feed)) = lower(trim(asked)) THEN 0 WHEN starts_with(lower(trim(feed)), lower(trim(asked))) THEN 1 ELSE 2 END match_rank
        FROM q JOIN f ON starts_with(lower(trim(feed)), lower(trim(asked))) OR starts_with(lower(trim(asked)), lower(trim(feed)))) SELECT asked, match, match_rank::BIGINT match_rank FROM p QUALIFY row_number() OVER (PARTITION BY asked ORDER BY match_rank, match) = 1""",
    "book_periods": """SELECT o_orderkey, f AS first, l AS last, date_diff('minute', f, l) / 60.0 AS hours FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + INTERVAL 11 HOUR ELSE o_orderdate::DATE::TIMESTAMP END f, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + INTERVAL 3 DAY + INTERVAL 930 MINUTE ELSE o_orderdate::DATE::TIMESTAMP END l FROM orders)""",
    "plain_bodies": """SELECT DISTINCT article_id, trim(regexp_replace(title || ' «да» & ещё', '[\\s\\x{A0}]+', ' ', 'g')) AS text, contains(regexp_replace(translate(upper(title), 'АВЕКМНОРСТХУ', 'ABEKMHOPCTXY'), '[^0-9A-ZА-Я]', '', 'g'), 'БAHK') bank,
        CASE WHEN contains(title, ',') THEN trim(substr(title, strpos(title, ',') + 1)) END issue FROM articles""",
}
