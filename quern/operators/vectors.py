"""TF-IDF, vocabularies, vector retrieval and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.scale import checked_broadcast


def tf_idf(texts: DataFrame, key: str, text: str, least_df: int = 5, most_df: float = 0.9) -> DataFrame:
    """(key, term, weight): raw counts times ln((1+n)/(1+df))+1, each text scaled to length one.

    Terms in fewer than ``least_df`` texts or in more than the part ``most_df`` of them are left out. Null texts have none but count in n.
    """
    n = texts.select(F.count(F.lit(1)).alias("__n"))
    tf = texts.where(F.col(text).isNotNull()).select(F.col(key), F.explode(tokens(F.lower(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    df = df.where((F.col("df") >= least_df) & (F.col("df") <= most_df * F.col("__n"))).select("term", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm"))
    return raw.join(norm, F.col(key) == F.col("__k")).select(key, "term", (F.col("w") / F.col("__norm")).alias("weight"))


def vocabulary(texts: DataFrame, text: str, size: int = 1500) -> DataFrame:
    """(term, n, index): the most frequent terms, from index 2 (0 pads, 1 stands for any other); ties by term."""
    counts = texts.where(F.col(text).isNotNull()).select(F.explode(tokens(F.lower(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1)


def index_sequences(texts: DataFrame, key: str, text: str, vocab: DataFrame, length: int | None = None) -> DataFrame:
    """(key, seq): the terms of each text as indices of the vocabulary, padded with 0 to the longest text, or cut and padded to ``length``."""
    terms = tokens(F.lower(text))
    rows = texts.select(F.col(key), F.posexplode_outer(terms if length is None else F.slice(terms, 1, length)).alias("pos", "term"))
    coded = rows.join(checked_broadcast(vocab.select("term", "index")), "term", "left")
    seq = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("pos", F.coalesce("index", F.lit(1)).alias("i"))))).alias("__s"))
    ids = F.transform("__s", lambda x: x["i"])
    longest = texts.agg(F.coalesce(F.max(F.when(F.col(text).isNotNull(), F.size(terms))), F.lit(0)).alias("__n")) if length is None else None
    seq = seq.withColumn("__n", F.lit(length)) if longest is None else seq.crossJoin(F.broadcast(longest))
    return seq.select(key, F.concat(ids, F.array_repeat(F.lit(0), F.col("__n") - F.size("__s"))).alias("seq"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def nearest(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, block: int = 20_000) -> DataFrame:
    """(query, key, similarity, place): the k items most similar to each query of a stated, small query set, ties by key.

    Queries are broadcast in blocks of about ``block`` by their hash, each a pass over the items; items are never shuffled as vectors. Of every partition only the
    best k for each query travel.
    """
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__qv"), F.sqrt(_dot(F.col(vector), F.col(vector))).alias("__qn"))
    v = items.select(F.col(key), F.col(vector).alias("__v"), F.sqrt(_dot(F.col(vector), F.col(vector))).alias("__vn"))
    blocks = -(-queries.count() // block) or 1
    scored = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        pairs = v.join(F.broadcast(part), F.col(key) != F.col("query"))
        one = pairs.select("query", key, F.try_divide(_dot(F.col("__qv"), F.col("__v")), F.col("__qn") * F.col("__vn")).alias("similarity"))
        scored = one if scored is None else scored.unionByName(one)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def knn_classify(queries: DataFrame, items: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """(query, predicted): the label most of the k nearest items have; ties go to the least label."""
    near = nearest(queries, items, key, vector, k).join(items.select(F.col(key), F.col(label).alias("__l")), key)
    votes = near.groupBy("query", "__l").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query").agg(F.max(F.struct("n", (-F.col("__l")).alias("m"))).alias("b"))
    return best.select("query", (-F.col("b.m")).alias("predicted"))


def chunks(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, tokens, text): windows of ``size`` tokens that overlap by ``overlap``; a short text is one chunk."""
    t = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " ")
    rows = texts.withColumn("__t", F.filter(t, lambda x: x != "")).where(F.size("__t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("__t") - overlap, F.lit(1)), F.lit(size - overlap))
    cut = rows.select(F.col(key), "__t", F.posexplode(starts).alias("chunk", "__from"))
    part = F.slice("__t", F.col("__from"), F.lit(size))
    return cut.select(key, "chunk", F.size(part).alias("tokens"), F.concat_ws(" ", part).alias("text"))
