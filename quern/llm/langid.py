"""Languages of documents and of the passages of mixed documents, each with a confidence.

A sparse multinomial logistic regression on TF-IDF weights of character n-grams, trained by follow-the-regularised-leader
(proximal, per-coordinate rates) with elastic-net penalties and calibrated by a temperature. It is fitted on a bounded sample of labelled
rows, whose labels may be wrong now and then: examples that a model of the other half contradicts are left out.

The features of a text are its n-grams' counts times their inverse document frequencies, over the root of their number. So the
score of a passage is a sum over its words, which are scored once per task. Passages are found by the best path through
the words, a change of language costing ``SWITCH`` or, after the end of a sentence, ``SWITCH_AT_SENTENCE``.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages told apart, and other ways of writing their codes.
LANGUAGES = ("de", "en", "es", "fr", "kk", "ru", "tr", "uk")
LONG_CODES = {"deu": "de", "ger": "de", "german": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr", "kaz": "kk", "kazakh": "kk", "rus": "ru", "russian": "ru", "tur": "tr", "turkish": "tr", "ukr": "uk", "ukrainian": "uk"}
NO_LANGUAGE = ("", "-", "und", "unknown", "n/a", "na", "none", "null", "?", "mul", "xx", "zxx")

#: Labelled rows fitted on, at most so many for each language; words of an example, spread over its text; share held out for the temperature.
SAMPLE_PER_LANGUAGE, EXAMPLE_WORDS, HELD_OUT = 800, 30, 0.2
NGRAMS = (1, 2, 3, 4)
#: Cost of a change of language within and after a sentence, and the words a passage has at least.
SWITCH, SWITCH_AT_SENTENCE, PASSAGE_WORDS = 4.5, 2.5, 6
_WORD = re.compile(r"[^\W_]+")
_WORD_AND_GAP = re.compile(r"([^\W_]+)([\W_]*)")
_SENTENCE_END = re.compile(r"[.!?…)][\"»”)]*\s|\n")


def label_code(label: Column) -> Column:
    """A label as a two-letter code: letter case, spaces, regions and three-letter codes aside; null if it names no language."""
    s = F.lower(F.trim(label))
    head = F.split(s, "[-_ ]")[0]
    long = F.create_map(*[F.lit(x) for kv in LONG_CODES.items() for x in kv])
    return F.when(s.isin(*NO_LANGUAGE) | (head == ""), None).otherwise(F.coalesce(long[head], head))


def ngrams(word: str) -> list[str]:
    """The n-grams of a lower-case word between boundary signs."""
    w = f"<{word}>"
    return [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)]


def text_words(text: str | None) -> list[str]:
    """The words of a text, made lower case if it is written in capitals for the most part."""
    if not text:
        return []
    return _WORD.findall(evened(text))


def evened(text: str) -> str:
    return text.lower() if sum(map(str.isupper, text)) > 0.4 * len(text) else text


def telling(word: str) -> bool:
    """Whether a word tells of its language: names, tickers and codes, written with a capital or digits, don't."""
    return word.islower() and word.isalpha()


class Model:
    """Weights of n-grams by language; scores of words are sums."""

    def __init__(self, grams: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        keep = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
        self.table = dict(zip([grams[i] for i in keep], (weights[keep] * idf[keep, None]).astype(np.float64)))
        self.bias, self.temperature = bias, temperature
        self.cache: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def word(self, w: str) -> np.ndarray:
        """Scores of the languages, then the number of n-grams; a word that tells nothing has none."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            got = np.zeros(len(LANGUAGES) + 1)
            if telling(w):
                for g in ngrams(w):
                    if (x := self.table.get(g)) is not None:
                        got[:-1] += x
                got[-1] = 4 * len(w) + 2
            self.cache[w] = got
        return got

    def probabilities(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of passages from the sums of their words' scores and numbers of n-grams."""
        z = (self.bias + scores / np.sqrt(np.maximum(counts, 1))[:, None]) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def spread_words(text: str, most: int = EXAMPLE_WORDS) -> list[str]:
    """At most ``most`` telling words, evenly spread over the whole text."""
    w = [w for w in text_words(text) if telling(w)]
    return w if len(w) <= most else [w[i * len(w) // most] for i in range(most)]


def _features(text: str) -> Counter:
    c: Counter = Counter()
    for w in spread_words(text):
        c.update(ngrams(w))
    return c


def _ftrl(rows, labels, idf, classes, epochs=2, alpha=0.3, beta=1.0, l1=0.02, l2=0.02, seed=3):
    """Weights (n-grams x classes) and bias of the regression on ``rows`` (indices, values)."""
    z, n = np.zeros((len(idf) + 1, classes)), np.zeros((len(idf) + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x = rows[r]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(idf) + 1))
    return w[:-1], w[-1]


def fit(examples: list[tuple[str, str]]) -> Model:
    """A model from (text, language) pairs; see the module's head. Without examples every language is as likely."""
    found = [(_features(t), LANGUAGES.index(y)) for t, y in examples]
    found = [(c, y) for c, y in found if c]
    df = Counter(g for c, _ in found for g in c)
    grams = sorted(g for g, k in df.items() if k >= 3)
    index = {g: i for i, g in enumerate(grams)}
    idf = np.array([np.log(1 + len(found) / df[g]) for g in grams])

    def row(c):
        total = sum(c.values())
        at = [(index[g], k) for g, k in c.items() if g in index]
        i = np.array([a for a, _ in at] + [len(grams)], np.int64)
        x = np.array([k for _, k in at], np.float64)
        return i, np.r_[x * idf[i[:-1]] / np.sqrt(total), 1.0]

    rows, y = [row(c) for c, _ in found], np.array([k for _, k in found], np.int64)
    if not rows:
        return Model([], np.zeros(0), np.zeros((0, len(LANGUAGES))), np.zeros(len(LANGUAGES)))
    held = np.arange(len(rows)) % round(1 / HELD_OUT) == 0

    def scores(w, b, which):
        return np.array([x[:-1] @ w[i[:-1]] + b for i, x in (rows[k] for k in which)])

    # each half is judged by a model of the other, so that no wrong label is learnt by heart; twice, the second time by clean halves
    half = np.arange(len(rows)) // 2 % 2
    agree = np.ones(len(rows), bool)
    for _ in range(2):
        said = np.empty(len(rows), np.int64)
        for h in (0, 1):
            use = np.flatnonzero((half == h) & agree)
            if len(use):
                w, b = _ftrl([rows[k] for k in use], y[use], idf, len(LANGUAGES), epochs=1)
                other = np.flatnonzero(half != h)
                if len(other):
                    said[other] = scores(w, b, other).argmax(axis=1)
            else:
                said[half != h] = y[half != h]
        agree = said == y
    use = np.flatnonzero(~held & agree)
    if not len(use):
        use = np.arange(len(rows))
    w, b = _ftrl([rows[k] for k in use], y[use], idf, len(LANGUAGES))
    test = np.flatnonzero(held & agree)
    temperature = 1.0
    if len(test):
        s = scores(w, b, test)

        def loss(t):
            u = s / t
            return float(np.mean(np.log(np.exp(u - u.max(axis=1, keepdims=True)).sum(axis=1)) + u.max(axis=1) - u[np.arange(len(u)), y[test]]))

        temperature = min(np.geomspace(0.2, 5, 33), key=loss)
    return Model(grams, idf, w, b, float(temperature))


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, code) pairs of each language, the same rows on every run."""
    rows = documents.where("text is not null").select("text", label_code(F.col("lang")).alias("code")).where(F.col("code").isin(*LANGUAGES))
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        return []
    part = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 1.1 * per_language / n))])
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def shorten(batches):
        for b in batches:
            yield pa.record_batch({"text": pa.array([" ".join(spread_words(t)) for t in b.column("text").to_pylist()], pa.string()), "code": b.column("code"), "place": b.column("place")})

    picked = rows.where(place < part[F.col("code")]).select("text", "code", place.alias("place")).mapInArrow(shorten, "text string, code string, place double").collect()
    out = []
    for code in sorted(counts):
        out += sorted((r["place"], r["text"], code) for r in picked if r["code"] == code)[:per_language]
    return [(t, c) for _, t, c in sorted(out)]


def _paths(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """The best language of every word: Viterbi over all texts of a batch at once. ``scores``: a row a word, texts one after another."""
    path = np.zeros(len(scores), np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    if not len(lengths) or not lengths[0]:
        return path
    k = scores.shape[1]
    back = np.zeros((len(scores), k), np.int8)
    best = np.zeros((len(lengths), k))
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    same = np.arange(k, dtype=np.int8)
    for t in range(lengths[0]):
        m = alive[t]
        b = best[:m]
        top = b.argmax(axis=1)
        at = starts[:m] + t
        change = b[np.arange(m), top] - switch[at]
        stay = b >= change[:, None]
        back[at] = np.where(stay, same, top[:, None].astype(np.int8))
        best[:m] = np.where(stay, b, change[:, None]) + scores[at]
    state = np.zeros(len(lengths), np.int8)
    for t in range(lengths[0] - 1, -1, -1):
        m = alive[t]
        ends = lengths[:m] == t + 1
        state[:m][ends] = best[:m][ends].argmax(axis=1)
        at = starts[:m] + t
        path[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return path


def _identify(batches, model: Model, switch: float, at_sentence: float, least: int):
    """doc_id, the text's language and confidence, and its passages (language, confidence, first word, words)."""
    k = len(LANGUAGES)
    passage = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first_word", pa.int32()), ("words", pa.int32())])
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            b = big.slice(at, 1000)
            pairs = [_WORD_AND_GAP.findall(evened(t)) if t else [] for t in b.column("text").to_pylist()]
            found = [[w for w, _ in x] for x in pairs]
            lengths = np.array([len(w) for w in found], np.int64)
            starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
            # words are numbered, and each different one is scored once
            ids: dict[str, int] = {}
            number = np.fromiter((ids.setdefault(w, len(ids)) for ws in found for w in ws), np.int64, int(lengths.sum()))
            table = np.array([model.word(w) for w in ids]) if ids else np.zeros((0, k + 1))
            per = table[number]
            # a word's evidence: its part of the score of a passage of twice the least length
            evidence = per[:, :k] / np.sqrt(2 * least * 24)
            ends: dict[str, bool] = {}
            closed = np.fromiter((ends[g] if g in ends else ends.setdefault(g, bool(_SENTENCE_END.search(g))) for x in pairs for _, g in x), bool, len(number))
            cost = np.where(np.r_[False, closed[:-1]] if len(closed) else closed, at_sentence, switch)
            path = _paths(evidence, starts, lengths, cost)
            sums = np.vstack([np.zeros(k + 1), np.cumsum(per, axis=0)])
            text_p = model.probabilities(sums[starts + lengths, :k] - sums[starts, :k], sums[starts + lengths, k] - sums[starts, k])
            new = np.ones(len(path), bool)
            new[1:] = path[1:] != path[:-1]
            new[starts[lengths > 0]] = True
            cut = np.flatnonzero(new)
            end = np.r_[cut[1:], len(path)]
            owner = np.repeat(np.arange(len(found)), lengths)[cut]
            p = model.probabilities(sums[end, :k] - sums[cut, :k], sums[end, k] - sums[cut, k])
            out: list[list[dict]] = [[] for _ in found]
            for o, s, e, q in zip(owner.tolist(), cut.tolist(), end.tolist(), range(len(cut))):
                lang = int(path[s])
                out[o].append((lang, float(p[q, lang]), s - int(starts[o]), e - s))
            langs, sure = [], []
            for i, parts in enumerate(out):
                # passages shorter than the least join the one before them (the first, the one after)
                if len(parts) > 1:
                    merged: list[tuple] = []
                    for x in parts:
                        if merged and (x[3] < least or merged[-1][0] == x[0] or merged[-1][3] < least):
                            y = merged.pop()
                            keep = y if y[3] >= x[3] else x
                            x = (keep[0], keep[1], y[2], y[3] + x[3])
                        merged.append(x)
                    out[i] = parts = merged
                text_lang = max(range(k), key=lambda a: sum(x[3] for x in parts if x[0] == a)) if parts else None
                langs.append(LANGUAGES[text_lang] if parts and lengths[i] and per[starts[i] : starts[i] + lengths[i], k].any() else None)
                sure.append(float(text_p[i, text_lang]) if langs[-1] else None)
            cells = [[{"lang": LANGUAGES[a], "confidence": c, "first_word": f, "words": n} for a, c, f, n in parts] if lang else [] for parts, lang in zip(out, langs)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang": b.column("lang"), "found_lang": pa.array(langs, pa.string()), "confidence": pa.array(sure, pa.float64()), "passages": pa.array(cells, pa.list_(passage))})


def identify_languages(documents: DataFrame, model: Model | None = None, switch: float = SWITCH, at_sentence: float = SWITCH_AT_SENTENCE, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, lang, found_lang, confidence, passages): the language of each document (doc_id, text, lang) and of its passages.

    ``passages`` lists (lang, confidence, first_word, words) in order. Documents whose text is null or has no letters get null and
    no passages. Without ``model`` one is fitted on the labels of a bounded sample (:data:`SAMPLE_PER_LANGUAGE`). Every row gives one row.
    """
    model = model or fit(labelled_sample(documents))
    known = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        lambda it: _identify(it, known.value, switch, at_sentence, least_words),
        "doc_id bigint, lang string, found_lang string, confidence double, passages array<struct<lang string, confidence double, first_word int, words int>>",
    )


def label_errors(found: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, found_lang): a row for each language of each document whose label is missing or another one, or which has passages in several."""
    held = F.array_distinct(F.transform(F.filter("passages", lambda x: x["words"] >= least_words), lambda x: x["lang"]))
    rows = found.where("found_lang is not null").withColumn("__code", label_code(F.col("lang"))).withColumn("__all", F.array_union(F.array("found_lang"), held))
    wrong = F.col("__code").isNull() | (F.size("__all") > 1) | ~F.array_contains("__all", F.col("__code"))
    return rows.where(wrong).select("doc_id", F.explode("__all").alias("found_lang")).distinct()
