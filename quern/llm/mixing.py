"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a random (seeded hash) order. Copy r of a document finishes at the virtual time
(tokens of the source up to and with it + r * all tokens of the source) / target share. Copies are taken in order of
finish time until the budget is full: while a source has documents left it keeps its share; one that is exhausted at its
cap leaves its time to the others, and the report says what it reached.

Running sums are distributed: documents fall into (source, hash range) buckets, bucket totals are summed up in a small table, and
only the rest is a window within a bucket. The cut at the budget works the same way on ranges of finish time, so no source,
however large, is ordered by one task.
"""

from __future__ import annotations

import base64
import functools
import importlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.scale import checked_broadcast, materialize

#: Ranges of the shuffled order per source; ranges of finish time, coarse and then fine ones within a coarse one: as many sums at most come to the driver.
ORDER_BUCKETS, TIME_BUCKETS = 512, 256


def _encoding(path: str):
    import tiktoken

    pattern = importlib.import_module("public_tokenizers").PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(batches, path: str):
    encoding = _encoding(path)
    for b in batches:
        n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": b.column("doc_id"), "source": b.column("source"), "tokens": pa.array(n, pa.int64())})


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens): the size of each text in tokens of the tiktoken vocabulary at path ``tokenizer``; null and empty texts have 0."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(functools.partial(_count_tokens, path=tokenizer), "doc_id bigint, source string, tokens bigint")


def _running(df: DataFrame, bucket: list[str], order: list[str], total: str, size: str) -> DataFrame:
    """Add ``total``: sum of ``size`` over all rows of the same bucket[:-1] up to and with this one in order of bucket[-1], ``order``."""
    sums = df.groupBy(*bucket).agg(F.sum(size).alias("__b"))
    before = Window.orderBy(bucket[-1]) if len(bucket) == 1 else Window.partitionBy(*bucket[:-1]).orderBy(bucket[-1])
    sums = sums.withColumn("__before", F.coalesce(F.sum("__b").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__in", F.sum(size).over(inner)).join(checked_broadcast(sums.select(*bucket, "__before")), bucket)
    return out.withColumn(total, F.col("__in") + F.col("__before")).drop("__in", "__before")


def fair_mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(source, doc_id, copy_no, tokens, finish): the documents of the mixture, one row for each use, in order of finish time.

    ``sizes`` (doc_id, source, tokens), ``targets`` (source, target_share, max_repeats), a row a source. ``budget`` in tokens; by default all
    tokens of the named sources. The mixture never exceeds it and lacks at most the size of its next document. Documents without
    source, id or tokens, or of a source without a positive share and cap, are left out. Copies of one document are used at most
    ``max_repeats`` times; ties in the order go by doc_id. Repeated rows of a document count as one. Empty inputs give an empty mixture.
    """
    known = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").cast("bigint").alias("cap"))
    rows = sizes.where("source is not null and doc_id is not null and tokens > 0").groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"))
    h = F.xxhash64(F.lit(seed), "source", "doc_id")
    rows = rows.join(checked_broadcast(known), "source").withColumn("__h", h).withColumn("__bucket", F.floor((h / 2.0**63 + 1) / 2 * ORDER_BUCKETS))
    rows = materialize(_running(rows, ["source", "__bucket"], ["__h", "doc_id"], "__upto", "tokens"), "order")
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("__all"), F.first("share").alias("share"), F.first("cap").alias("cap"))
    stats = totals.collect()  # a row a source of the target table
    if budget is None:
        budget = sum(r["__all"] for r in stats)
    cut = _virtual_time([(r["__all"] * r["cap"], r["share"]) for r in stats], budget)
    width = max(cut, 1e-9) * 1.0001 / TIME_BUCKETS**2
    most = max([r["cap"] for r in stats], default=1)
    copies = rows.join(F.broadcast(totals.select("source", "__all")), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.least(F.col("cap"), F.lit(most)).cast("int"))))
    copies = copies.withColumn("finish", (F.col("__upto") + (F.col("copy_no") - 1) * F.col("__all")) / F.col("share"))
    # one document a source may end behind the cut and still fit
    longest = rows.agg(F.max(F.col("tokens") / F.col("share"))).first()[0] or 0.0
    time = F.least(F.floor(F.col("finish") / width), F.lit(2 * TIME_BUCKETS**2)).cast("bigint")
    copies = copies.where(F.col("finish") <= cut + 2 * longest).withColumn("__time", time).withColumn("__coarse", F.floor(F.col("__time") / TIME_BUCKETS))
    full, edge = _first_over(copies, "__coarse", 0, budget)
    taken = copies
    if edge is not None:
        within = copies.where(F.col("__coarse") == edge)
        full, fine = _first_over(within, "__time", full, budget)
        inner = Window.partitionBy("__time").orderBy("finish", "source", "doc_id", "copy_no").rowsBetween(Window.unboundedPreceding, 0)
        rim = within.where(F.col("__time") == fine).withColumn("__sum", F.sum("tokens").over(inner)).where(F.col("__sum") <= budget - full).drop("__sum")
        taken = copies.where(F.col("__coarse") < edge).unionByName(within.where(F.col("__time") < fine)).unionByName(rim)
    return taken.select("source", "doc_id", "copy_no", "tokens", "finish").orderBy("finish", "source", "doc_id", "copy_no")


def _first_over(copies: DataFrame, ranges: str, full: int, budget: int) -> tuple[int, int | None]:
    """(tokens before it, number) of the first range that ends over the budget, ``full`` tokens being taken already; None if there is none."""
    for r in copies.groupBy(ranges).agg(F.sum("tokens").alias("n")).orderBy(ranges).collect():
        if full + r["n"] > budget:
            return full, r[ranges]
        full += r["n"]
    return full, None


def _virtual_time(sources: list[tuple[float, float]], budget: float) -> float:
    """The time at which sources of the given (capacity, share) have put out ``budget`` together, or all they have."""
    at, left = 0.0, float(budget)
    for end, _ in sorted((c / s, s) for c, s in sources):
        rate = sum(s for c, s in sources if c / s > at)
        if rate * (end - at) >= left:
            return at + left / rate
        left -= rate * (end - at)
        at = end
    return at


def mix_report(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target source: tokens and documents used, most uses of a document, share reached, whether the cap kept it from its target."""
    used = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy_no").alias("most_uses"))
    have = sizes.where("source is not null and doc_id is not null").groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = mixture.agg(F.sum("tokens").alias("total"))
    targets = targets.select("source", "target_share", "max_repeats")
    out = targets.join(used, "source", "left").join(have, "source", "left").crossJoin(F.broadcast(total)).na.fill(0, ["tokens", "uses", "most_uses", "source_tokens"])
    share = F.coalesce(F.try_divide(F.col("tokens"), F.col("total")), F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "source_tokens", "tokens", "uses", "most_uses", F.round(share, 6).alias("share_reached"),
                      (F.col("source_tokens") * F.col("max_repeats") < F.col("target_share") * F.col("total")).alias("capped"))
