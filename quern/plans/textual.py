"""Text, matching and retrieval on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import values as V
from quern.operators import matching as M
from quern.operators import vectors as X
from quern.sources.tables import table


def normalize_text(spark, d):
    m = table(spark, d, "comments", "comment_id", "text").distinct()
    return m.select("comment_id", T.normalize_match_text(F.col("text")).alias("norm"), F.size(T.tokens(T.normalize_match_text(F.col("text")))).cast("bigint").alias("tokens"), T.says_little(F.col("text")).alias("short"))


def bigram_counts(spark, d):
    """The 500 most frequent bigrams of the documents: a top-k report."""
    t = table(spark, d, "documents", "text").select(T.tokens(T.normalize_match_text(F.col("text"))).alias("t"))
    g = t.select(F.explode(T.ngrams(F.col("t"), 2, 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(500)


def keyword_flags(spark, d):
    m = table(spark, d, "messages", "channel", "text")
    bond, primary = T.flag_any(F.col("text"), ["облигац", "купон", "оферт"]), T.flag_any(F.col("text"), ["размещен", "книг", "букбилд"])
    return m.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(bond | primary).alias("bond"), F.count_if(primary).alias("primary"))


def text_length_filter(spark, d):
    words = F.size(F.split(F.trim(F.col("text")), " "))
    c = table(spark, d, "comments", "comment_id", "text").where(words.between(2, 13))
    return c.groupBy(F.length("text").cast("bigint").alias("chars")).agg(F.count(F.lit(1)).alias("n"))


def range_upper_bound(spark, d):
    """The upper end of the first range in part names made into ranges, and of texts with 'с … до …'."""
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    s = F.concat(F.lit("ориентир "), F.col("p_size").cast("string"), F.lit(",5 - "), (F.col("p_size") + F.col("p_partkey") % 3).cast("string"), F.lit(".25 %"))
    return p.select("p_partkey", V.range_upper(s).alias("upper"))


def comma_decimals(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice")
    s = F.translate(F.format_number("p_retailprice", 2), ",.", " ,")
    return p.select("p_partkey", V.number(s).alias("value"))


def homoglyph_keys(spark, d):
    a = table(spark, d, "issuer_aliases", "alias").distinct()
    return a.select("alias", T.homoglyph_key(F.col("alias")).alias("key"))


def alias_hits(spark, d):
    """Issuers named in posts by the longest listed alias."""
    p = table(spark, d, "posts", "post_id", "text").distinct()
    h = M.entity_hits(p, "post_id", "text", table(spark, d, "issuer_aliases"))
    return h.select("post_id", "issuer", F.concat_ws("|", "aliases").alias("aliases"))


def alias_resolution(spark, d):
    p = table(spark, d, "comments", "comment_id", "text").distinct()
    h = M.entity_hits(p, "comment_id", "text", table(spark, d, "issuer_aliases"))
    return M.resolution(h, "comment_id")


def alias_ambiguity(spark, d):
    t = table(spark, d, "telegram_matches", "issuer", "matched_aliases")
    return M.alias_ambiguity(t, F.col("matched_aliases"), "issuer")


def issuer_rows_suppressed(spark, d):
    t = table(spark, d, "telegram_matches", "source_key", "issuer", "entity_level").where("entity_level is not null").distinct().withColumnRenamed("entity_level", "level")
    return M.suppress_issuer_rows(t, "source_key").groupBy("issuer", "level").agg(F.count(F.lit(1)).alias("n"))


def alias_mining(spark, d):
    """Grams of one to three words by source, over whole texts (no windows around listed names)."""
    out = M.mine_aliases(table(spark, d, "documents", "source", "text"), "source", "text")
    return out.select("source", "gram", "docs_in", "docs_out", F.round("score", 6).alias("score"))


def tfidf(spark, d):
    """Terms of the eval items by weight; the sum of squares of an item is one."""
    w = X.tf_idf(table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")
    return w.select("item_id", "term", F.round("weight", 6).alias("weight"))


def token_vocabulary(spark, d):
    return X.vocabulary(table(spark, d, "eval_items", "text"), "text", 200).select("term", "n", F.col("index").cast("bigint").alias("index"))


def index_sequences(spark, d):
    """Whole texts of the eval items over the vocabulary of 1,500 terms, padded to the longest."""
    e = table(spark, d, "eval_items", "item_id", "text")
    s = X.index_sequences(e, "item_id", "text", X.vocabulary(e, "text"))
    return s.select("item_id", F.array_join("seq", ",").alias("seq"))


def cosine_topk(spark, d):
    """For every twentieth vector, as stated query set, the 10 most similar of all."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    n = X.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10)
    return n.select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


def knn_majority(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return X.knn_classify(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", "label", 10).withColumn("predicted", F.col("predicted").cast("bigint"))


def chunked_documents(spark, d):
    c = X.chunks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 60, 20)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))


def corpus_scan(spark, d):
    """Texts of three sources over 30 characters, by source."""
    parts = [table(spark, d, t, c).select(F.lit(t).alias("src"), F.col(c).alias("text")) for t, c in (("messages", "text"), ("posts", "text"), ("comments", "text"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length("text") > 30)
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def snippets(spark, d):
    """Posts where coupon and offer stand near each other."""
    p = table(spark, d, "posts", "post_id", "text").distinct()
    return p.where(T.near_context(F.col("text"), "купон", "оферт")).select("post_id", T.snippet(F.col("text"), "купон").alias("snippet"))


_NAMES = "normalize_text bigram_counts keyword_flags text_length_filter range_upper_bound comma_decimals homoglyph_keys alias_hits alias_resolution alias_ambiguity issuer_rows_suppressed alias_mining tfidf token_vocabulary index_sequences cosine_topk knn_majority chunked_documents corpus_scan snippets"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_NORM = "trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё—–', 'е--'), '[^a-zа-я0-9.-]+', ' ', 'g'))"
_TOK = "'[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*'"
_LOW = "('+', '++', 'ага', 'угу', 'ок', 'окей', 'да', 'нет', 'согласен', 'не согласен', 'норм', 'лол', 'жесть', 'имхо', 'ясно', 'понятно', 'спасибо', 'thanks')"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_MINED = "regexp_extract_all(trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё—–', 'е--'), '[\\s\\x{A0}]+', ' ', 'g')), '[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*')"
ORACLE = {
    "snippets": "SELECT post_id, trim(regexp_replace(substr(text, greatest(strpos(lower(text), 'купон') - 220, 1), 440), '[\\s\\x{A0}]+', ' ', 'g')) snippet FROM (SELECT DISTINCT post_id, text FROM posts) WHERE regexp_matches(lower(text), '(?s)купон.{0,280}оферт|оферт.{0,280}купон')",
    "index_sequences": f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), {_TOK}) k FROM eval_items), u AS (SELECT item_id, unnest(k) term, generate_subscripts(k, 1) pos FROM t), v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 i FROM (SELECT term, count(*) n FROM u GROUP BY 1 ORDER BY n DESC, term LIMIT 1500)),
        s AS (SELECT item_id, list(coalesce(i, 1) ORDER BY pos) l FROM u LEFT JOIN v USING (term) GROUP BY 1), m AS (SELECT max(len(k)) n FROM t) SELECT item_id, array_to_string(list_concat(l, list_transform(range(n - len(l)), lambda x: 0)), ',') seq FROM s, m""",
    "alias_mining": f"""WITH d AS (SELECT row_number() OVER () r, source, {_MINED} k FROM documents WHERE source IS NOT NULL),
        g AS (SELECT DISTINCT r, source, unnest(list_concat(k, list_concat(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])))) gram FROM d),
        o AS (SELECT source, gram, count(*) docs_in FROM g WHERE length(gram) >= 3 AND NOT regexp_matches(gram, '^[0-9 .-]+$') GROUP BY ALL), a AS (SELECT gram, sum(docs_in) n FROM o GROUP BY 1),
        s AS (SELECT source, gram, docs_in, (n - docs_in)::BIGINT docs_out, docs_in / (1 + n - docs_in) * ln(1 + docs_in) score FROM o JOIN a USING (gram) WHERE docs_in >= 4 AND n - docs_in <= 3)
        SELECT source, gram, docs_in, docs_out, round(score, 6) score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, docs_in DESC, gram) <= 25""",
    "normalize_text": f"SELECT comment_id, norm, len(regexp_extract_all(norm, {_TOK})) tokens, norm = '' OR norm IN {_LOW} OR len(regexp_extract_all(norm, {_TOK})) <= 2 AS short FROM (SELECT DISTINCT comment_id, text, {_NORM} norm FROM comments)",
    "bigram_counts": f"""WITH t AS (SELECT doc_id, regexp_extract_all({_NORM}, {_TOK}) k FROM documents), g AS (SELECT unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) gram FROM t)
        SELECT gram, count(*) n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 500""",
    "keyword_flags": "SELECT channel, count(*) n, count(*) FILTER (regexp_matches(lower(text), 'облигац|купон|оферт|размещен|книг|букбилд')) bond, count(*) FILTER (regexp_matches(lower(text), 'размещен|книг|букбилд')) AS \"primary\" FROM messages GROUP BY 1",
    "text_length_filter": "SELECT length(text) chars, count(*) n FROM comments WHERE len(string_split(trim(text), ' ')) BETWEEN 2 AND 13 GROUP BY 1",
    "range_upper_bound": "SELECT p_partkey, greatest(p_size + 0.5, p_size + p_partkey % 3 + 0.25)::DOUBLE AS upper FROM part",
    "comma_decimals": "SELECT p_partkey, round(p_retailprice, 2) AS value FROM part",
    "homoglyph_keys": "SELECT DISTINCT alias, regexp_replace(translate(upper(alias), 'АВЕКМНОРСТХУ', 'ABEKMHOPCTXY'), '[^0-9A-ZА-Я]', '', 'g') AS key FROM issuer_aliases",
    "alias_ambiguity": "SELECT alias, count(*) n, count(DISTINCT issuer) issuers FROM (SELECT issuer, unnest(from_json(matched_aliases, '[\"VARCHAR\"]')) alias FROM telegram_matches) GROUP BY 1",
    "issuer_rows_suppressed": """WITH t AS (SELECT DISTINCT source_key, issuer, entity_level AS level FROM telegram_matches WHERE entity_level IS NOT NULL)
        SELECT issuer, level, count(*) n FROM t a WHERE level = 'offering' OR NOT EXISTS (SELECT 1 FROM t b WHERE b.source_key = a.source_key AND b.issuer = a.issuer AND b.level = 'offering') GROUP BY ALL""",
    "tfidf": f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), {_TOK})) term FROM eval_items), f AS (SELECT item_id, term, count(*) tf FROM t GROUP BY ALL), n AS (SELECT count(*) n FROM eval_items),
        d AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 idf FROM f, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.9 * n)
        SELECT item_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)), 6) weight FROM f JOIN d USING (term)""",
    "token_vocabulary": f"SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 1 AS index FROM (SELECT unnest(regexp_extract_all(lower(text), {_TOK})) term, count(*) n FROM eval_items GROUP BY 1 ORDER BY n DESC, term LIMIT 200)",
    "cosine_topk": f"SELECT a.vec_id query, b.vec_id, round({_COS}, 6) similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10",
    "knn_majority": f"""WITH n AS (SELECT a.vec_id query, b.label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10),
        c AS (SELECT query, label, count(*) n FROM n GROUP BY ALL) SELECT query, label::BIGINT predicted FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""",
    "chunked_documents": """WITH w AS (SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) n FROM documents), c AS (SELECT doc_id, n, unnest(range(1, greatest(n - 20, 1) + 1, 40)) s FROM w WHERE n > 0)
        SELECT doc_id, count(*) chunks, sum(least(60, n - s + 1))::BIGINT tokens FROM c GROUP BY doc_id""",
    "corpus_scan": "SELECT src, count(*) n, sum(length(text))::BIGINT chars FROM (SELECT 'messages' src, text FROM messages UNION ALL SELECT 'posts', text FROM posts UNION ALL SELECT 'comments', text FROM comments) WHERE length(text) > 30 GROUP BY 1",
}
