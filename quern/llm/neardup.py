"""Near-duplicate texts by BK-trees over bit fingerprints.

Every text becomes its set of shingles (runs of words). Records with the same words form a class; only
classes are compared. A class has a fingerprint of 128 bits, bit i being a bit of its i-th MinHash,
whose Hamming distance falls with the similarity of the shingle sets. BK-trees (children keyed by the integer
Hamming distance to their parent) are searched within a radius.

The distance that a similarity of one half implies (32 of 128, 47 allowed) lies too near to that of unrelated texts (64)
for one tree over everything to prune; its search would touch almost every node. So the trees are built per shard,
a shard being the classes that share a band of MinHashes, and neighbours are sought within the shards. Instead of being
broadcast, which would grow with the corpus, a shard's tree is built by the task that holds the shard. A shard of over
``SHARD_ROWS`` classes is cut into tiles of bounded size which meet each other tile in tasks of their own; shards that a sample
shows to be as large are cut before they are shuffled, so that none comes to one task. Every pair found is verified
exactly on the shingle sets.

A pair of similarity s shares a band with probability 1-(1-s^ROWS)^bands, whatever its shingles; :func:`bands_for` gives the number of bands.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import WordHasher, mix, run_hashes, text_hash, words
from quern.scale import materialize

#: MinHashes of a band, the most bands, and a chance of sharing one beyond which no more are drawn.
ROWS, BANDS, SURE = 3, 28, 0.9995
#: Most classes of a shard searched in one tree, and of a tree's leaf, whose values are compared directly.
SHARD_ROWS, LEAF = 4096, 32
#: Classes of the sample that tells large shards beforehand.
SAMPLE_CLASSES = 50_000
#: Bits of a fingerprint, held in words of 64.
BITS = 128


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def minhash(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """n MinHashes of each of the sets (32-bit shingle hashes), a row a set; all must have elements."""
    return _minhash(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]], n, seed)


def _minhash(flat: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    flat = flat.astype(np.uint64)
    out = np.empty((len(starts), n), np.uint64)
    v, w = np.empty_like(flat), np.empty_like(flat)
    for j, m in enumerate(_multipliers(n, seed)):
        np.add(flat, np.uint64(j + 1), out=v)
        np.multiply(v, m, out=v)
        np.right_shift(v, np.uint64(32), out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, m, out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


class BKTree:
    """A tree of integers under Hamming distance; children are keyed by their distance to the parent."""

    __slots__ = ("value", "items", "children")

    def __init__(self, value: int, item: int):
        self.value, self.items, self.children = value, [item], {}

    def add(self, value: int, item: int) -> None:
        node = self
        while d := (value ^ node.value).bit_count():
            nxt = node.children.get(d)
            if nxt is None:
                node.children[d] = BKTree(value, item)
                return
            node = nxt
        node.items.append(item)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Items at most ``radius`` away; only edges d - radius .. d + radius are followed."""
        stack = [self]
        while stack:
            node = stack.pop()
            d = (value ^ node.value).bit_count()
            if d <= radius:
                yield from node.items
            stack += [child for edge, child in node.children.items() if d - radius <= edge <= d + radius]


def radius_for(similarity: float, bits: int = 64, sigmas: float = 3.0) -> int:
    """The Hamming radius that pairs of at least ``similarity`` exceed with the chance of ``sigmas`` deviations at most."""
    p = (1 - similarity) / 2
    return round(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def _raw_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1) - (1 << 63)


def bands_for(similarity: float, rows: int = ROWS, most: int = BANDS) -> int:
    """The number of bands by which a pair of ``similarity`` shares one with the chance SURE, ``most`` at most."""
    return 1 if similarity >= 1 else min(most, math.ceil(math.log(1 - SURE) / math.log(1 - similarity**rows)))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, the last axis being their words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def near_values(values: np.ndarray, radius: int, items: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of the values (a row of 64-bit words each) at most ``radius`` apart: a search of the BK-tree of all values for each of them at once.

    A node's value is compared with all values that reach it, and its children (keyed by their distance to it) get those of them
    whose distance differs from the key by ``radius`` at most. Up to ``LEAF`` values below a node are a leaf. With ``items`` the
    tree is of the values at these places (ascending), searched for all others.
    """
    n, out = len(values), []
    inner = np.zeros(n, bool)
    if items is not None:
        inner[items] = True
    stack = [(np.arange(n), np.arange(n)) if items is None else (np.flatnonzero(~inner), items)]
    while stack:
        q, i = stack.pop()
        if not len(q) or not len(i):
            continue
        if min(len(q), len(i)) <= LEAF:
            x, y = np.nonzero(_distance(values[q][:, None], values[i][None, :]) <= radius)
            out.append((q[x], i[y]))
            continue
        d = _distance(values[q], values[i[0]])
        near = q[d <= radius]
        out.append((near, np.full(len(near), i[0])))
        edge = _distance(values[i[1:]], values[i[0]])
        for e in np.unique(edge):
            stack.append((q[np.abs(d - int(e)) <= radius], i[1:][edge == e]))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    if items is None:
        keep = a < b
        return a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


def _shingled(batches: Iterator[pa.RecordBatch], run: int, least_words: int, short: bool = False) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Class and shingles of each text, None for one too short; with ``short`` such a text has its class too (None for a null text), and no shingles."""
    hasher = WordHasher()
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            w = words(text)
            if len(w) < max(least_words, run):
                # texts without a word are alike only if they are equal
                out.append((None if text is None else text_hash(hasher(w)) if w else _raw_hash(text), None) if short else None)
                continue
            h = hasher(w)
            out.append((text_hash(h), np.unique((run_hashes(h, run) >> np.uint64(32)).astype(np.uint32))))
        yield b, out


def _describe(batches, run: int, least_words: int, short: bool = False):
    """tbl, key, cls, sh: the class of each record and, once a task, its shingles."""
    seen = set()
    for b, out in _shingled(batches, run, least_words, short):
        keep = [i for i, x in enumerate(out) if x]
        cls = [out[i][0] for i in keep]
        tbl, sets = b.column("tbl").to_pylist(), []
        for i in keep:
            one = tbl[i], out[i][0]
            new = out[i][1] is not None and one not in seen
            sets.append(out[i][1].view(np.int32) if new else None)
            if new:
                seen.add(one)
        at = pa.array(keep, pa.int64())
        yield pa.record_batch({"tbl": b.column("tbl").take(at), "key": b.column("key").take(at), "cls": pa.array(cls, pa.int64()), "sh": pa.array(sets, pa.list_(pa.int32()))})


def _bands(batches, rows: int, bands: int, hot: dict[int, int]):
    """Band, class and fingerprint of each class of a batch; of hot bands, with the number of their tiles, a row for each pair of tiles (side 0 or 1)."""
    large = np.array(sorted(hot), np.int64)
    for b in batches:
        sets = [np.asarray(x, np.int32).view(np.uint32) for x in b.column("sh").to_numpy(zero_copy_only=False)]
        if not sets:
            continue
        cls = b.column("cls").to_numpy()
        tbl = b.column("tbl").to_numpy(zero_copy_only=False)
        names = {t: xxhash.xxh3_64_intdigest(t or "") for t in set(tbl)}
        which = np.array([names[t] for t in tbl], np.uint64)
        m = minhash(sets, max(BITS, rows * bands), seed=7)
        fp = _fingerprints(m)
        for j in range(bands):
            key = which + np.uint64(j)
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, j * rows + r])
            key = key.view(np.int64)
            is_hot = np.isin(key, large) if len(large) else np.zeros(len(key), bool)
            cold = np.flatnonzero(~is_hot)
            yield _banded(key[cold], cls[cold], fp[cold])
            for i in np.flatnonzero(is_hot).tolist():
                tiles = hot[int(key[i])]
                own = int(mix(cls[i : i + 1].view(np.uint64))[0] % np.uint64(tiles))
                other = np.arange(tiles)
                yield _banded(np.full(tiles, key[i]), np.full(tiles, cls[i]), np.repeat(fp[i : i + 1], tiles, axis=0), np.minimum(own, other), np.maximum(own, other), (own > other).astype(np.int32))


def _banded(band, cls, fp, x=None, y=None, side=None) -> pa.RecordBatch:
    none = pa.nulls(len(band), pa.int32())
    cells = [pa.array(c.astype(np.int32), pa.int32()) if c is not None else none for c in (x, y, side)]
    return pa.record_batch([pa.array(band), pa.array(cls), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1])), *cells], names=["band", "cls", "fp", "fq", "x", "y", "side"])


_BANDED = "band bigint, cls bigint, fp bigint, fq bigint, x int, y int, side int"


def _fingerprints(m: np.ndarray) -> np.ndarray:
    """(sets, 2): the two words of each fingerprint."""
    bits = (m[:, :BITS] >> np.uint64(40)) & np.uint64(1)
    halves = bits.reshape(len(m), 2, 64) << np.arange(64, dtype=np.uint64)
    return halves.sum(axis=2, dtype=np.uint64).view(np.int64)


def hot_bands(shingles: DataFrame, rows: int, bands: int, limit: int, sample: int = SAMPLE_CLASSES) -> dict[int, int]:
    """band -> number of tiles, of the bands that hold over 8 * ``limit`` classes by a sample of about ``sample`` of them.

    At most sample * bands / 8 bands come to the driver, whatever the size of the corpus. A band that the sample misses is cut into tiles by the task
    that gets it; the result is the same.
    """
    part = max(1, round(shingles.count() / sample))
    if part == 1:
        return {}  # all of a shard is then no more than a task's work
    picked = shingles.where(F.pmod(F.xxhash64("cls"), F.lit(part)) == 0)
    counts = picked.mapInArrow(lambda it: _bands(it, rows, bands, {}), _BANDED).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return {r["band"]: -(-r["n"] * part // limit) for r in counts.where(F.col("n") >= max(8, 8 * limit / part)).collect()}


def _search(band: np.ndarray, cls: np.ndarray, fp: np.ndarray, radius: int, limit: int, out: list, rest: list) -> None:
    """Pairs within the radius in each run of equal bands; runs over the limit go to ``rest``."""
    order = np.lexsort((cls, band))
    band, cls, fp = band[order], cls[order], fp[order]
    first = np.r_[True, (band[1:] != band[:-1]) | (cls[1:] != cls[:-1])]  # a class once in a band
    band, cls, fp = band[first], cls[first], fp[first]
    starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    size = np.diff(np.r_[starts, len(band)])
    bits = fp.view(np.uint64)
    for n in np.unique(size[(size > 1) & (size <= LEAF)]).tolist():
        # trees that are one leaf, all of one size at once
        at = starts[size == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        for part in np.array_split(at, len(at) * len(i) // 1_000_000 + 1):
            x, y = part[:, i], part[:, j]
            near = _distance(bits[x], bits[y]) <= radius
            out.append((cls[x[near]], cls[y[near]]))
    for s, n in zip(starts[size > LEAF].tolist(), size[size > LEAF].tolist()):
        if n > limit:
            rest.append((band[s : s + n], cls[s : s + n], fp[s : s + n]))
            continue
        a, b = near_values(bits[s : s + n], radius)
        out.append((cls[s + a], cls[s + b]))


_FOUND = "kind int, a bigint, b bigint, fp bigint, fq bigint, pos bigint"


def _search_sorted(batches, radius: int, limit: int):
    """Pairs (kind 0: a, b) and members of over-large shards (kind 1: band, cls as a, b, with their position) of rows sorted by band."""
    held: list = []  # pieces of the run that is not known to have ended
    spilled, position = None, 0  # band of a run already over the limit

    def emit(kind, a, b, fp=None, pos=None):
        none = pa.nulls(len(a), pa.int64())
        p, q = (none, none) if fp is None else (pa.array(np.ascontiguousarray(fp[:, k])) for k in (0, 1))
        cells = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), p, q, none if pos is None else pa.array(pos, pa.int64())]
        return pa.record_batch(cells, names=["kind", "a", "b", "fp", "fq", "pos"])

    def done(band, cls, fp):
        out, rest = [], []
        _search(band, cls, fp, radius, limit, out, rest)
        if out:
            a, b = (np.concatenate(x) for x in zip(*out))
            yield emit(0, np.minimum(a, b), np.maximum(a, b))
        for band, ids, f in rest:
            yield emit(1, band, ids, f, np.arange(len(ids)))

    for x in batches:
        band, cls = (x.column(c).to_numpy() for c in ("band", "cls"))
        fp = np.stack([x.column(c).to_numpy() for c in ("fp", "fq")], axis=1)
        if not len(band):
            continue
        if spilled is not None:
            more = int(np.searchsorted(band, spilled, side="right")) if band[0] == spilled else 0
            if more:
                yield emit(1, band[:more], cls[:more], fp[:more], position + np.arange(more))
                position += more
            if more == len(band):
                continue
            spilled, band, cls, fp = None, band[more:], cls[more:], fp[more:]
        held.append((band, cls, fp))
        band, cls, fp = (np.concatenate(c) for c in zip(*held))
        last = int(np.searchsorted(band, band[-1], side="left"))
        if last:
            yield from done(band[:last], cls[:last], fp[:last])
        tail = band[last:], cls[last:], fp[last:]
        held = [tail]
        if len(tail[0]) > 8 * limit:  # flush: its members go to the tiles
            spilled, position = int(tail[0][0]), len(tail[0])
            yield emit(1, *tail, np.arange(position))
            held = []
    if held:
        yield from done(*(np.concatenate(c) for c in zip(*held)))


def _search_tile(radius: int):
    def tile(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["cls", "side"])
        cls, fp, side = pdf["cls"].to_numpy(), pdf[["fp", "fq"]].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:
            a, b = near_values(fp, radius)
        else:
            a, b = near_values(fp, radius, np.flatnonzero(side == 0))
        return pd.DataFrame({"a": np.minimum(cls[a], cls[b]), "b": np.maximum(cls[a], cls[b])})

    return tile


def text_classes(records: DataFrame, run: int = 3, least_words: int = 20, short: bool = False) -> DataFrame:
    """(tbl, key, cls, sh), written once: the class of every record with enough words (with ``short`` of every record), its shingles on one row a task."""
    return materialize(records.select("tbl", "key", "text").mapInArrow(functools.partial(_describe, run=run, least_words=least_words, short=short), "tbl string, key string, cls bigint, sh array<int>"), "classes")


def similar_classes(classes: DataFrame, similarity: float = 0.5, rows: int = ROWS, limit: int = SHARD_ROWS, sample: int = SAMPLE_CLASSES) -> DataFrame:
    """(a, b, similarity) with a < b: pairs of different classes of one table whose shingle sets have at least that Jaccard similarity."""
    radius, bands = radius_for(similarity, BITS), bands_for(similarity, rows)
    shingles = classes.where("sh is not null").select("tbl", "cls", "sh")
    hot = hot_bands(shingles, rows, bands, limit, sample)
    banded = shingles.mapInArrow(lambda it: _bands(it, rows, bands, hot), _BANDED)
    if hot:
        banded = materialize(banded, "bands")
    shards = banded.where("x is null").select("band", "cls", "fp", "fq").repartition("band").sortWithinPartitions("band")
    found = materialize(shards.mapInArrow(lambda it: _search_sorted(it, radius, limit), _FOUND), "shards")
    pairs = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select(F.col("a").alias("band"), F.col("b").alias("cls"), "fp", "fq", F.floor(F.col("pos") / limit).alias("tile"))
    tiles = large.groupBy("band").agg(F.max("tile").alias("top"))
    large = large.join(tiles, "band")
    spread = large.select("band", "cls", "fp", "fq", "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("other"))
    spread = spread.select("band", "cls", "fp", "fq", F.least("tile", "other").cast("int").alias("x"), F.greatest("tile", "other").cast("int").alias("y"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    if hot:
        spread = spread.unionByName(banded.where("x is not null"))
    more = spread.groupBy("band", "x", "y").applyInPandas(_search_tile(radius), "a bigint, b bigint")
    pairs = pairs.unionByName(more).where("a <> b").distinct()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = shingles.select("cls", "sh").join(needed, "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(one.select(F.col("cls").alias("a"), F.col("sh").alias("sa")), "a").join(one.select(F.col("cls").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
    return both.where(F.col("similarity") >= similarity)


def near_duplicate_pairs(records: DataFrame, run: int = 3, least_words: int = 20, similarity: float = 0.5, limit: int = SHARD_ROWS, sample: int = SAMPLE_CLASSES) -> DataFrame:
    """(tbl, key_a, key_b, similarity), key_a < key_b: records (tbl, key, text) of one table with similar texts.

    Similarity is the Jaccard similarity of the sets of runs of ``run`` words. Records with null key or text, or with
    fewer than ``least_words`` words, are in no pair. Repeated rows of a record count once; a record is never paired with itself.
    Records with the same words are paired too (similarity 1). An empty input gives an empty result.
    """
    records = records.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    classes = text_classes(records, run, least_words)
    links = materialize(similar_classes(classes, similarity, limit=limit, sample=sample), "links")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    members = classes.select("tbl", "key", "cls").distinct()
    copied = members.groupBy("tbl", "cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"))
    near = members.select("tbl", F.col("key").alias("key_a"), F.col("cls").alias("a"))
    pairs = near.join(links.unionByName(copied.distinct()), "a")
    pairs = pairs.join(members.select("tbl", F.col("key").alias("key_b"), F.col("cls").alias("b")), ["tbl", "b"])
    return pairs.where("key_a < key_b").select("tbl", "key_a", "key_b", "similarity").distinct()


def duplicate_groups(records: DataFrame, run: int = 5, least_words: int = 5, similarity: float = 0.8, short: bool = False) -> DataFrame:
    """(tbl, key, cls, links): one row per record: its class of same-worded texts, and the number of other classes like it.

    Texts too short for a shingle are left out, or with ``short`` have the class of their words (of the text as it is, if it has none) and
    0 links; a null text then has the class null. Repeated rows of a record count once. Records without a key are left out.
    """
    records = records.where(F.col("key").isNotNull() if short else F.col("key").isNotNull() & F.col("text").isNotNull())
    classes = text_classes(records, run, least_words, short)
    links = similar_classes(classes, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    members = classes.select("tbl", "key", "cls").distinct()
    return members.join(degree, "cls", "left").select("tbl", "key", "cls", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def class_links(records: DataFrame, run: int = 5, least_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(tbl, cls_a, cls_b, similarity), cls_a < cls_b: the classes of :func:`duplicate_groups` that are alike, once for each table that has both.

    With the membership of the groups these are all similar pairs of records, without those between copies being written out.
    """
    classes = text_classes(records.where(F.col("key").isNotNull() & F.col("text").isNotNull()), run, least_words)
    links = similar_classes(classes, similarity)
    of = classes.select("tbl", "cls").distinct()
    return links.join(of.withColumnRenamed("cls", "a"), "a").join(of.withColumnRenamed("cls", "b"), ["tbl", "b"]).select("tbl", F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "similarity")
