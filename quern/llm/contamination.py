"""Evaluation passages inside training documents, by spaced-seed hashing.

A seed is a fixed mask over consecutive words: 1 keeps a word, 0 ignores it, so a changed word under a 0 does not hide
the seed. The seeds of the held-out items and those of the documents are equi-joined by their hashes; the items' side is
broadcast if a check of its size allows it, else both are shuffled. Hits are counted by document, item and range of diagonals (place in the
document less place in the item); places with ``LEAST_SEEDS`` of them are verified on the words. An item leaks if at least
``LEAST_WORDS`` consecutive words of it occur with at most one edit (word changed, dropped or added) in ``PER_EDIT``; edits at
the rim of a passage count as any others.

The mask 1111 alone makes the search complete for the defaults: n words with n/7 edits keep at least n - 4 n/7 - 3 seeds of it, which
is three for 14 words, and more for longer passages. The spaced masks add hits where words are changed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import WordHasher, mix, words
from quern.scale import checked_broadcast, materialize

MASKS = ("1111", "11011", "110101", "1010011")
LEAST_WORDS, PER_EDIT = 14, 7
#: Fewest seeds (of all masks) in a place worth aligning.
LEAST_SEEDS = 3
#: Most items whose seeds may be broadcast, if their bytes allow it.
BLOCK_ITEMS = 20_000
#: Bits of the filter by which documents leave out seeds no item has. Its size is fixed; with more items it lets more pass, and loses none.
FILTER_BITS = 1 << 23
#: Words hashed at a time; a longer text is a chunk of its own.
CHUNK_WORDS = 100_000


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each placement of the mask on the word hashes ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(32)
    return mix(out)


def longest_passage(item: np.ndarray, text: np.ndarray, low: int, high: int, least_words: int = LEAST_WORDS, per_edit: int = PER_EDIT) -> tuple[int, int] | None:
    """(words, edits) of the longest passage of ``item`` in ``text`` with at most one edit in ``per_edit`` words, or None.

    Both are word hashes. Alignments on the diagonals (place in the text less place in the item) low to high are tried.
    For every start in the item and every number of edits the furthest place is kept that is reached on each diagonal, so no
    alignment is missed. Words changed at the rim, before the first or behind the last that is kept, are part of the passage if the
    text has words in their place; words left out or added at the rim are not.
    """
    n, m = len(item), len(text)
    if n < least_words or not m:
        return None
    diagonal = np.arange(low, high + 1)
    at = np.arange(n)[:, None] + diagonal[None, :]
    inside = (at >= 0) & (at < m)
    same = inside & (text[np.clip(at, 0, m - 1)] == item[:, None])
    # some least_words words of a passage have twice the edits of so many at most, so that many less keep a word on some diagonal
    kept_words = np.r_[0, np.cumsum(same.any(axis=1))]
    if (kept_words[least_words:] - kept_words[:-least_words]).max() < least_words - 2 * least_words // per_edit:
        return None
    wide = len(diagonal)
    # the first place from i on where the diagonal's words differ, as a flat table
    stop = np.full((n + 2, wide), n, np.int64)
    stop[:n] = np.where(same, n, np.arange(n)[:, None])
    stop = np.minimum.accumulate(stop[::-1], axis=0)[::-1].ravel()
    more = np.zeros((n + 2, wide), np.int64)
    more[:n] = inside
    starts = n - least_words + 1  # a later start has too few words behind it
    more, column, start = more.ravel(), np.arange(wide), np.arange(starts)[:, None]
    front = np.broadcast_to(start, (starts, wide))  # only changed words so far
    fits = np.ones((starts, wide), np.int64)
    reach = np.full((starts, wide), -1, np.int64)  # begun with a kept word, whatever came last; -1 not yet
    ended, best = reach, None  # a kept word came last, or only changed ones since

    def kept(place, valid):
        """Places moved on over kept words, and the same or -1 where there was none."""
        slid = np.where(valid, stop.take(place * wide + column), -1)
        return slid, np.where(slid > place, slid, -1)

    for edits in range(n // per_edit + 1):
        if edits:
            fits = fits * more.take(front * wide + column)
            front = np.minimum(front + fits, n)
            held = np.maximum(reach, 0)
            tail = np.maximum(ended, 0)
            ended = np.where(ended >= 0, tail + more.take(tail * wide + column), -1)
            begun = reach >= 0
            left, right = np.zeros_like(held), np.zeros_like(held)
            left_ok, right_ok = np.zeros_like(begun), np.zeros_like(begun)
            left[:, 1:], left_ok[:, 1:] = held[:, :-1], begun[:, :-1]  # a word added
            right[:, :-1], right_ok[:, :-1] = np.minimum(held[:, 1:] + 1, n), begun[:, 1:]  # a word dropped
            moved = [kept(held + more.take(held * wide + column), begun), kept(left, left_ok), kept(right, right_ok), kept(front, fits > 0)]
            reach = np.maximum(np.maximum(moved[0][0], moved[1][0]), np.maximum(moved[2][0], moved[3][1]))
            ended = np.maximum(np.maximum(np.maximum(moved[0][1], moved[1][1]), np.maximum(moved[2][1], moved[3][1])), ended)
        else:
            reach = ended = kept(front, fits > 0)[1]
        longest = int((ended.max(axis=1) - start[:, 0]).max())
        if longest >= max(least_words, edits * per_edit) and (best is None or longest > best[0]):
            best = longest, edits
    return best


def passage(item: list[str], window: list[str], least_words: int = LEAST_WORDS, per_edit: int = PER_EDIT) -> tuple[int, int] | None:
    """(words, edits) of the longest passage of ``item`` in ``window`` (lists of words) within the tolerance, or None."""
    hasher = WordHasher()
    return longest_passage(hasher(item), hasher(window), -len(item), len(window), least_words, per_edit)


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The filter of a column ``seed``: 64 bits a word; the words are put together by the tasks, and at most FILTER_BITS / 64 come to the driver."""
    slot = F.pmod("seed", F.lit(FILTER_BITS))
    parts = seeds.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))")).alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for w, b in parts.collect():
        out[w] = b
    return out.view(np.uint64)


def _seed_rows(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...], known: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """(id, seed, place, n) of rows (id, text): every seed (that ``known`` lets pass) with its place among the n words of the text."""
    hasher = WordHasher()
    passing = None if known is None else known.value

    def rows(ids, lists):
        count = np.array([len(w) for w in lists], np.int64)
        h = np.concatenate([hasher(w) for w in lists])
        which = np.repeat(np.arange(len(lists)), count)
        place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        ids = np.array(ids, np.int64)
        for mask in masks:
            s = seeds(h, mask)
            inside = which[: len(s)] == which[len(mask) - 1 :] if len(s) else np.empty(0, bool)
            if passing is not None:
                slot = s & np.uint64(FILTER_BITS - 1)
                inside &= (passing[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            inside = np.flatnonzero(inside)
            w = which[inside]
            yield pa.record_batch([pa.array(ids[w]), pa.array(s[inside].view(np.int64)), pa.array(place[inside].astype(np.int32)), pa.array(count[w].astype(np.int32))], names=["id", "seed", "place", "n"])

    for b in batches:
        ids, lists, size = [], [], 0
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            if w := words(text):
                ids.append(i)
                lists.append(w)
                size += len(w)
            if size >= CHUNK_WORDS:
                yield from rows(ids, lists)
                ids, lists, size = [], [], 0
        if lists:
            yield from rows(ids, lists)


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges of diagonals, joined where they touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _verify(batches: Iterator[pa.RecordBatch], least_words: int, per_edit: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    known: dict[int, np.ndarray] = {}
    last, doc = None, np.empty(0, np.uint64)
    for b in batches:
        out = []
        for d, text, i, key, item, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_key", "item_text", "ranges"))):
            if text is not last and text != last:
                last, doc = text, hasher(words(text))
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = hasher(words(item))
            held = known[key]
            slack, best = len(held) // per_edit, None
            for low, high in _merged(ranges):
                # an alignment through the hits leaves their diagonals by as many words as it may have edits
                low, high = low - slack, high + slack
                window = doc[max(0, low) : max(0, high + len(held))]
                got = longest_passage(held, window, low - max(0, low), high - max(0, low), least_words, per_edit)
                if got and (best is None or (got[0], -got[1]) > (best[0], -best[1])):
                    best = got
            if best:
                out.append((d, i, *best))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "words", "edits"])


def leaked_items(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, per_edit: int = PER_EDIT, masks: tuple[str, ...] = MASKS, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, words, edits): each document with each item of which it holds a passage, and the longest passage.

    ``documents`` (doc_id, text), ``items`` (item_id, text). Rows with null ids or texts take no part; items of fewer than
    ``least_words`` words can't leak. Repeated rows of a document or an item yield one row per pair; other columns are ignored.
    Seeds of more than ``block`` items, or of more bytes than may be broadcast, are shuffled to those of the documents.
    The documents are read once for their seeds, whatever the number of items, and once for the texts of the places to verify.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    # a key of id and text: an id that comes with several texts has each of them
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    held = materialize(held.withColumn("item_key", F.xxhash64("item_id", "text")), "items")
    spread = functools.partial(_seed_rows, masks=masks)
    known = held.select(F.col("item_key").alias("id"), "text").mapInArrow(spread, "id bigint, seed bigint, place int, n int")
    known = materialize(known.where(F.col("n") >= least_words).select(F.col("id").alias("item_key"), "seed", F.col("place").alias("at"), "n").distinct(), "seeds")
    passing = docs.sparkSession.sparkContext.broadcast(_filter_of(known))
    found = docs.select(F.col("doc_key").alias("id"), "text").mapInArrow(functools.partial(_seed_rows, masks=masks, known=passing), "id bigint, seed bigint, place int, n int").select(F.col("id").alias("doc_key"), "seed", "place")
    few = held.limit(block + 1).count() <= block
    hits = found.join(checked_broadcast(known) if few else known, "seed")
    # hits of one passage lie on diagonals n / per_edit apart at most: in one of the overlapping ranges of twice that width they all lie
    width = F.floor(F.col("n") / per_edit) + 1
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    first = F.floor((F.col("place") - F.col("at")) / width)
    ranges = hits.select("doc_key", "item_key", diagonal, F.explode(F.array(first, first - 1)).alias("range")).groupBy("doc_key", "item_key", "range")
    ranges = ranges.agg(F.count(F.lit(1)).alias("hits"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    places = ranges.where(F.col("hits") >= LEAST_SEEDS).groupBy("doc_key", "item_key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    places = materialize(places, "places")
    pairs = docs.join(places, "doc_key").join(checked_broadcast(held.select("item_key", "item_id", F.col("text").alias("item_text"))), "item_key")
    out = pairs.select("doc_id", "text", "item_id", "item_key", "item_text", "ranges").mapInArrow(functools.partial(_verify, least_words=least_words, per_edit=per_edit), "doc_id bigint, item_id bigint, words bigint, edits bigint")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("edits")).alias("less"))).alias("x")).select("doc_id", "item_id", "x.words", (-F.col("x.less")).alias("edits"))
