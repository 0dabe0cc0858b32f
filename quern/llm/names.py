"""Linking of spelling variants of organisation names to a register.

Every name is rewritten to canonical forms: one script (letters that look alike, Latin transliteration and text typed
in the wrong keyboard layout become Cyrillic), no legal form, words in any order, joined, abbreviated, inflected or with a
diminutive ending. For typing errors both sides also give their forms with up to two letters left out. The forms are exploded and
equi-joined; a link scores by the rarity of the form it came by (the fewer organisations share a form the more it
says) less the cost of the rewriting. A spelling that several organisations reach with the same score is linked to each of them and counts its ties.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.scale import checked_broadcast, materialize

# Legal forms and words for an organisation, keyboard rows, letters that look alike, transliteration, endings.
LEGAL = {"пао", "гк", "мкпао", "ооо", "ао", "оао", "зао", "нко", "корп", "корпорация", "группа", "компания", "холдинг", "фирма", "pao", "ooo", "ao", "gk", "llc", "jsc", "pjsc", "inc", "ltd", "plc"}
KEYS_LATIN = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`"
KEYS_RUSSIAN = "йцукенгшщзхъфывапролджэячсмитьбюё"
LOOKALIKES = dict(zip("abcehkmoptxyunr", "авсенкмортхуипг"))
TRANSLITERATION = [("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "е"), ("a", "а"), ("b", "б"), ("c", "к"), ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("h", "х"), ("i", "и"), ("j", "ж"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("q", "к"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("v", "в"), ("w", "в"), ("x", "х"), ("y", "и"), ("z", "з")]
CASE_ENDINGS = ("а", "у", "е", "ом", "ем", "ы", "и", "ю", "я", "ой", "ей", "ов", "ам", "овский", "овская", "овского", "овские")
DIMINUTIVES = ("ик", "чик", "ок", "ек", "ушка", "юшка", "ыч", "ич", "ка", "ша", "уха", "ан", "ас", "он")

_TO_RUSSIAN = str.maketrans(KEYS_LATIN, KEYS_RUSSIAN)
_WORD = re.compile(r"[^\W_]+")
_CYRILLIC, _LATIN = re.compile(r"[а-яё]"), re.compile(r"[a-z]")
_TRANSLIT = dict(TRANSLITERATION)
_TRANSLIT_RX = re.compile("|".join(a for a, _ in TRANSLITERATION))
_SAME = str.maketrans({"ы": "и", "й": "и", "ь": None, "ъ": None, "э": "е", "ё": "е"})
#: Letters left out on either side for typing errors, and the least length of a form to allow one and two of them.
MOST_EDITS, LEAST_ONE, LEAST_TWO = 2, 6, 8
#: Score lost for each unit of cost, in units of log rarity.
COST_WEIGHT = 1.0
#: A rewriting that costs more (with its edits) is no evidence.
MOST_COST = 3.4
#: Windows of a text up to so many words (more, if a registered name has more) are tried as a name.
MOST_WORDS = 6
#: Least length of a form without another: up to it only forms that are a whole name count, and only as they are. From LONG on typing errors are sought by halves.
LEAST_FORM, LONG, OVERLAP = 5, 32, 3
#: Names of more words are reordered by sorting them instead of by all permutations.
MOST_PERMUTED = 4
#: Bytes of keyed forms that may be broadcast (a form of the register is about 40 bytes a key).
FORM_BYTES = 128 << 20
#: Names of the register held in memory at once; a larger one is taken in parts by issuer.
REGISTER_NAMES = 100_000


def plain(name: str) -> str:
    """Letter case, punctuation and ё/е aside."""
    return " ".join(_WORD.findall(name.lower().replace("ё", "е")))


def fold(word: str) -> str:
    """A lower-case word in one script, without soft signs and doubled letters."""
    return squeeze(script(word))


def script(word: str) -> str:
    """A lower-case word in one script, without soft signs."""
    if _LATIN.search(word):
        if _CYRILLIC.search(word):
            word = "".join(LOOKALIKES.get(c, c) for c in word)
        word = _TRANSLIT_RX.sub(lambda m: _TRANSLIT[m[0]], word)
    return word.translate(_SAME)


def squeeze(text: str) -> str:
    return "".join(c for i, c in enumerate(text) if not i or text[i - 1] != c)


def deletions(form: str, most: int = MOST_EDITS) -> Iterator[str]:
    """``form`` with up to ``most`` letters left out, as its length allows."""
    yield form
    n = len(form)
    for k in range(1, min(most, (n >= LEAST_ONE) + (n >= LEAST_TWO)) + 1):
        for drop in combinations(range(n), k):
            yield "".join(form[a + 1 : b] for a, b in zip((-1, *drop), (*drop, n)))


def _one_left_out(form: str) -> Iterator[str]:
    yield form
    for i in range(len(form)):
        yield form[:i] + form[i + 1 :]


def keys_of(form: str, asked: bool, most: int = MOST_EDITS) -> Iterator[str]:
    """Keys of which two forms at most MOST_EDITS apart (as their lengths allow) share one: ``asked`` for a spelling, else of the register.

    Forms up to LONG letters meet by their deletions. Longer ones, whose deletions would grow as the square of the length, meet by halves: of two edits
    one half of the registered form has one at most (a swap over the middle is one in each half), so a half with up to one letter left out
    equals a beginning or end of the spelling, of about that length, with up to one left out. With ``most`` 1 forms up to LONG letters meet within one edit only.
    """
    n = len(form)
    if n <= LONG:
        yield from deletions(form, most)
    if n > LONG - OVERLAP:
        if asked:
            for m in range((n - MOST_EDITS) // 2 - 1, (n + MOST_EDITS + 1) // 2 + 2):
                for k in _one_left_out(form[:m]):
                    yield f"<{k}"
                for k in _one_left_out(form[n - m :]):
                    yield f">{k}"
        else:
            for k in _one_left_out(form[: n // 2]):
                yield f"<{k}"
            for k in _one_left_out(form[n // 2 :]):
                yield f">{k}"


def word_keys(word: str) -> Iterator[str]:
    """``word`` with up to one letter left out, from seven letters on up to two."""
    yield word
    n = len(word)
    for k in range(1, (n >= 4) + (n >= 7) + 1):
        for drop in combinations(range(n), k):
            yield "".join(word[a + 1 : b] for a, b in zip((-1, *drop), (*drop, n)))


def edit_distance(a: str, b: str, most: int = MOST_EDITS) -> int:
    """Insertions, deletions, changes and swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _stems(word: str) -> list[tuple[str, float]]:
    """Abbreviations of a word of a name: beginnings, first and last letters, consonants."""
    n = len(word)
    out = [(word[:k], 1.0) for k in range(1 if n < 9 else 3, min(n, 6))]
    out += [(word[:k] + word[-j:], 1.0) for k in (1, 2, 3) for j in (1, 2) if n > k + j + 1]
    consonants = re.sub("[аеиоуюя]", "", word)
    out += [(consonants, 1.0), (consonants[:3], 1.0)]
    return [(squeeze(w), c) for w, c in out if len(w) >= 2]


def register_forms(core: list[str], head: int) -> dict[str, tuple[float, bool]]:
    """form -> (cost, may have typing errors) of a registered name given as folded words without legal forms.

    ``head`` is the word that tells it from others. Abbreviations, blends and diminutives are formed around it or, at a
    higher cost, around any other long word. Doubled letters count once, but forms for typing errors are also given with them.
    """
    raw, core = core, [squeeze(w) for w in core]
    out: dict[str, tuple[float, bool]] = {}

    def put(parts, cost, editable=False, whole=False):
        form = squeeze("".join(parts))
        if form and (whole or len(form) >= LEAST_FORM) and (form not in out or cost < out[form][0]):
            out[form] = cost, editable or (form in out and out[form][1])

    # of a longer name the words in alphabetical order stand for every order; spellings are sorted likewise
    for order in permutations(raw) if len(raw) <= MOST_PERMUTED else [tuple(raw), tuple(sorted(raw))]:
        cost = 0.0 if list(order) == raw else 0.5
        put(order, cost, True, True)
        out.setdefault("".join(order), (cost, True))
    for i, w in enumerate(core):
        for end in CASE_ENDINGS:
            for cut in (0, 1):
                if len(w) - cut >= 4:
                    put([*core[:i], w[: len(w) - cut] + fold(end), *core[i + 1 :]], 0.6)
    for h, main in enumerate(core):
        if len(main) < 6:
            continue
        before, after, far = core[:h], core[h + 1 :], 0.0 if h == head else 0.6
        starts = [main[:k] for k in range(max(5, len(main) - 5), len(main) + 1)]
        short = [x[:3] for x in (*before, *after)]
        for s in starts:
            cost = far + 0.5 + 0.1 * (len(main) - len(s))
            for a, c in [("", 0.0)] if not after else [*[(x, c) for w in after for x, c in _stems(w)], ("".join(after), 0.3)]:
                for b in {"".join(before), ""}:
                    put([b, s, a], cost + c + (0.7 if before and not b else 0))
            if short:
                put([s, *short], cost + 0.5)
                put([s, short[0]], cost + 0.8)
            for end in DIMINUTIVES:
                for b, a, c in ((before, after, 0), ([], [], 0.7 * bool(before or after))):
                    put([*b, s + fold(end), *a], cost + 0.3 + c)
            if after and h == head:
                put([*before, s], cost + 1.3)
    return out


def split_layout(chunk: str, known: frozenset[str]) -> str:
    """A lower-case chunk between spaces, read in the Russian layout if only that gives parts of known names."""
    if _CYRILLIC.search(chunk.replace("ё", "")) or not _LATIN.search(chunk):
        return chunk
    body = chunk.strip("()\"«»“”!?:")
    best, most = chunk, grams_held(fold("".join(_WORD.findall(body))), known)
    for x in {body, body.rstrip(".,;")}:
        read = x.translate(_TO_RUSSIAN)
        if (held := grams_held(fold("".join(_WORD.findall(read))), known)) > most + 0.2:
            best, most = chunk.replace(x, read), held
    return best


def grams_held(word: str, known: frozenset[str]) -> float:
    """The part of the word's runs of four letters that occur in registered names."""
    n = len(word) - 3
    return sum(word[i : i + 4] in known for i in range(n)) / n if n > 0 else 0.0


def name_words(name: str, known: frozenset[str]) -> list[str]:
    """Lower-case words of a name, layout put right."""
    out: list[str] = []
    for chunk in name.lower().split():
        out += _WORD.findall(split_layout(chunk, known))
    return out


class Register:
    """Registered names as canonical forms: a reference table, or a part of one, of at most about REGISTER_NAMES names."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.listed: dict[str, set[str]] = {}
        cores: dict[str, set[tuple[str, ...]]] = {}
        self.codes: list[tuple[str, str]] = []  # tickers: only as they are
        for issuer, alias in rows:
            for name in (issuer, alias):
                if not name:
                    continue
                self.listed.setdefault(issuer, set()).add(plain(name))
                core = tuple(script(w) for w in _WORD.findall(name.lower().replace("ё", "е")) if w not in LEGAL)
                if len(core) == 1 and name.isupper() and len(name) <= 6:
                    self.codes.append((issuer, squeeze(core[0])))
                elif any(core):
                    cores.setdefault(issuer, set()).add(tuple(filter(None, core)))
        owners: dict[str, set[str]] = {}
        for issuer, names in cores.items():
            for w in {w for core in names for w in core}:
                owners.setdefault(w, set()).add(issuer)
        rank = lambda w: (len(owners[w]), -len(w))
        self.cores = sorted((issuer, list(core), min(range(len(core)), key=lambda i: rank(core[i]))) for issuer, names in cores.items() for core in names)  # noqa: B023
        words = {squeeze(w) for names in cores.values() for core in names for w in core}
        self.known = frozenset(w[i : i + 4] for w in words for i in range(len(w) - 3))
        heads = {squeeze(min(core, key=rank)) for names in cores.values() for core in names}
        self.main = frozenset(w[i : i + 4] for w in heads for i in range(len(w) - 3))
        self.beginnings = frozenset(w[:k] for w in heads for k in range(1, len(w)))
        self.heads = frozenset(heads)
        self.near = frozenset(k for w in words for k in word_keys(w))
        self.parts = frozenset(x for w in words for x, _ in _stems(w))
        self.longest = max((len(core) for _, core, _ in self.cores), default=0)

    def forms(self, spark: SparkSession) -> DataFrame:
        """(registered, issuer, cost, editable): all forms of the names."""
        names = spark.createDataFrame(self.cores, "issuer string, core array<string>, head int").repartition(spark.sparkContext.defaultParallelism)

        def rewrite(batches):
            for b in batches:
                rows = [(f, i, c, e) for i, core, h in zip(*(b.column(c).to_pylist() for c in ("issuer", "core", "head"))) for f, (c, e) in register_forms(core, h).items()]
                yield _batch(rows, _FORM)

        codes = spark.createDataFrame([(f, i, 0.0, False) for i, f in self.codes], "registered string, issuer string, cost double, editable boolean")
        return names.mapInArrow(rewrite, "registered string, issuer string, cost double, editable boolean").unionByName(codes)


def keyed_forms(forms: DataFrame, organisations: int) -> DataFrame:
    """(key, registered, issuer, cost, rarity): the keys of all forms; those of editable forms include them with letters left out."""

    def keys(batches):
        for b in batches:
            cells = zip(*(b.column(c).to_pylist() for c in ("registered", "issuer", "cost", "editable", "rarity")))
            yield _batch([(key_of(k), f, i, c, r) for f, i, c, e, r in cells for k in (set(keys_of(f, False)) if e else (f,))], _KEYED)

    forms = forms.groupBy("registered", "issuer").agg(F.min("cost").alias("cost"), F.max("editable").alias("editable"))
    owners = F.count(F.lit(1)).over(Window.partitionBy("registered"))
    forms = forms.withColumn("rarity", F.log(F.lit(float(max(1, organisations))) / owners) + 1)
    return forms.mapInArrow(keys, "key bigint, registered string, issuer string, cost double, rarity double")


_FORM = pa.schema([("registered", pa.string()), ("issuer", pa.string()), ("cost", pa.float64()), ("editable", pa.bool_())])
_KEYED = pa.schema([("key", pa.int64()), ("registered", pa.string()), ("issuer", pa.string()), ("cost", pa.float64()), ("rarity", pa.float64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def key_of(form: str) -> int:
    """The join key of a form: a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(form) - (1 << 63)


def _explode_forms(batches, known: frozenset[str], longest: int, most: int):
    """name -> (name, form, key): keys of the folded name without legal forms, whole and with letters left out. Forms over ``longest`` letters equal none."""
    schema = pa.schema([("name", pa.string()), ("form", pa.string()), ("key", pa.int64())])
    for b in batches:
        out = []
        for name in b.column("name").to_pylist():
            w = [x for x in name_words(name, known) if x not in LEGAL]
            raw = "".join(script(x) for x in w)
            forms = {raw, squeeze(raw)}
            if len(w) > MOST_PERMUTED:
                ordered = "".join(sorted(script(x) for x in w))
                forms |= {ordered, squeeze(ordered)}
            for form in (f for f in forms if 0 < len(f) <= longest):
                out += [(name, form, key_of(key)) for key in {form, *keys_of(form, True, most)}]
            if len(out) > 20_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)


def _distances(batches):
    for b in batches:
        d = [edit_distance(x, y) for x, y in zip(b.column("form").to_pylist(), b.column("registered").to_pylist())]
        yield pa.record_batch([*b.columns, pa.array(d, pa.int32())], names=[*b.schema.names, "edits"])


def link_names(names: DataFrame, registers: list[Register]) -> DataFrame:
    """(name, issuer, registered, score, ties): each distinct non-null ``name`` with the organisation it links to.

    ``registered`` is the form of the register by which it links. A name that several organisations reach with the same best score has a row
    for each, ``ties`` being their number. Names of less than five letters link only to a name or ticker with the same letters.
    """
    spark = names.sparkSession
    known = frozenset().union(*(r.known for r in registers))
    forms = functools.reduce(DataFrame.unionByName, (r.forms(spark) for r in registers))
    organisations = len({i for r in registers for i in r.listed})
    forms = materialize(keyed_forms(forms, organisations), "forms")
    longest = (forms.agg(F.max(F.length("registered"))).first()[0] or 0) + MOST_EDITS
    forms = checked_broadcast(forms, 2_000_000, FORM_BYTES)
    # the names are few bytes but each is hundreds of keys: spread by number, which adaptive execution leaves alone, and by
    # another expression than distinct() has used, or the exchange is optimised away
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = names.where("name is not null").select("name").distinct()

    def found(names, most):
        exploded = names.repartition(parts, F.xxhash64("name")).mapInArrow(functools.partial(_explode_forms, known=known, longest=longest, most=most), "name string, form string, key bigint")
        hits = exploded.join(forms, "key").groupBy("name", "form", "registered", "issuer").agg(F.min("cost").alias("cost"), F.max("rarity").alias("rarity"))
        hits = hits.mapInArrow(_distances, "name string, form string, registered string, issuer string, cost double, rarity double, edits int")
        allowed = F.when(F.length("registered") < LEAST_ONE, 0).when(F.length("registered") < LEAST_TWO, 1).otherwise(MOST_EDITS)
        hits = hits.where((F.col("edits") <= allowed) & (F.col("cost") + F.col("edits") <= MOST_COST)).withColumn("score", F.round(F.col("rarity") - COST_WEIGHT * (F.col("cost") + F.col("edits")), 6))
        return hits.select("name", "issuer", "registered", "score")

    # all links within one edit first; a name needs those of two only if such a link could still score as much: at best the greatest rarity less two edits
    near = materialize(found(asked, 1), "near")
    bound = math.log(max(1, organisations)) + 1 - COST_WEIGHT * MOST_EDITS + 1e-6
    settled = near.groupBy("name").agg(F.max("score").alias("s")).where(F.col("s") > bound).select("name")
    hits = near.join(settled, "name", "left_semi").unionByName(found(asked.join(settled, "name", "left_anti"), MOST_EDITS))
    best = hits.groupBy("name", "issuer").agg(F.max(F.struct("score", "registered")).alias("x"))
    whole = Window.partitionBy("name")
    best = best.withColumn("top", F.max("x.score").over(whole)).where("x.score = top").withColumn("ties", F.count(F.lit(1)).over(whole))
    return best.select("name", "issuer", F.col("x.registered").alias("registered"), F.col("x.score").alias("score"), "ties")


def _windows(batches, register: Register):
    """(row_key, anchor, name, core): windows of the words of a text that may hold a registered name."""
    main, known, beginnings = register.main, register.known, register.beginnings
    most, reach = max(MOST_WORDS, register.longest + 1), max(4, register.longest)
    held: dict[str, tuple[str, float]] = {}
    read: dict[str, str] = {}

    def look(w):
        if w not in held:
            if len(held) > 500_000:
                held.clear()
            f = fold(w)
            held[w] = f, grams_held(f, main)
        return held[w]

    fits: dict[str, bool] = {}

    def fit(w):
        if w not in fits:
            if len(fits) > 500_000:
                fits.clear()
            f = look(w)[0]
            fits[w] = not w.isdigit() and (len(f) <= 3 or w in LEGAL or grams_held(f, known) >= 0.3 or f in register.parts or not register.near.isdisjoint(word_keys(f)))
        return fits[w]

    def chunk_words(c):
        if c not in read:
            if len(read) > 500_000:
                read.clear()
            read[c] = split_layout(c, main)
        return read[c]

    legal_after = re.compile(r"^[»”\"]?\s*\(([^()]{2,20})\)")
    for b in batches:
        out = []
        for key, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist()):
            if not text or key is None:
                continue
            low = " ".join(chunk_words(c) for c in text.lower().split())
            found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
            n = len(found)
            for i, (w, start, end) in enumerate(found):
                if w.isdigit():
                    continue
                f, part = look(w)
                whole = part >= 0.5 and len(f) >= 5
                broken = not whole and f in beginnings and i + 1 < n and found[i + 1][1] - end <= 3 and look(found[i + 1][0])[0] not in register.heads and grams_held(squeeze(f + look(found[i + 1][0])[0]), main) >= 0.6
                if not whole and not broken:
                    continue
                for a in range(i, max(-1, i - reach), -1):
                    if not fit(found[a][0]):
                        break
                    if a < i and len(found[a][0]) <= 2:
                        continue
                    for z in range(i + 1 + broken, min(n, a + most, i + reach + 1) + 1):
                        # a window does not reach over a sentence or a number
                        inner = low[found[a][1] : found[z - 1][2]]
                        if not fit(found[z - 1][0]):
                            break
                        if z - 1 > i + broken and len(found[z - 1][0]) <= 2:
                            continue
                        if re.search(r"[.!?…]\s|[\n,:;]", re.sub(r"(?<=\w)\.\s(?=[а-яa-z]{1,4}\b)", " ", inner)):
                            continue
                        core = [x[0] for x in found[a:z]]
                        if core[0] in LEGAL or core[-1] in LEGAL:
                            continue
                        left = found[a - 1][0] if a and found[a - 1][0] in LEGAL - {"холдинг"} and re.fullmatch(r"[\s.«“\"]*", low[found[a - 1][2] : found[a][1]]) else ""
                        after = legal_after.match(low[found[z - 1][2] : found[z - 1][2] + 30])
                        right = plain(after[1]) if after and plain(after[1]) in LEGAL else ""
                        out.append((key, i, inner, " ".join(x for x in (left, plain(inner), right) if x)))
        yield pa.record_batch([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())], names=["row_key", "anchor", "name", "written"])


def registers_of(aliases: DataFrame, most: int = REGISTER_NAMES) -> list[Register]:
    """The (issuer, alias) rows of a reference table in memory: counted first, and taken in parts by issuer of about ``most`` names each, none of which is held beside another part's rows."""
    rows = aliases.where("issuer is not null").select("issuer", "alias").distinct()
    parts = max(1, -(-rows.count() // most))
    part = lambda k: rows if parts == 1 else rows.where(F.pmod(F.xxhash64("issuer"), F.lit(parts)) == k)
    return [Register([(r["issuer"], r["alias"]) for r in part(k).toLocalIterator()]) for k in range(parts)]


def link_fields(fields: DataFrame, texts: DataFrame, aliases: DataFrame, most: int = REGISTER_NAMES) -> DataFrame:
    """(tbl, row_key, issuer, written, listed, ties): organisations named in ``fields`` (tbl, row_key, name: a name each) and ``texts`` (tbl, row_key, text).

    ``written`` is the spelling, ``listed`` whether it is one of the organisation's own in the register (letter case,
    punctuation and ё/е aside); in a text a legal form or a word like 'group' beside a listed spelling is no part of the name. ``ties`` is the number of organisations
    that the spelling may mean, 1 for a link without doubt. Rows with null keys, names or texts take no part; repeated rows give one row.
    Names that link to none are left out. A register of more than ``most`` names is taken in parts, each a pass over the texts.
    """
    spark = aliases.sparkSession
    registers = registers_of(aliases, most)
    keyed = texts.where("row_key is not null and text is not null").select(F.concat_ws("\u0001", "tbl", "row_key").alias("row_key"), "text")
    found = [keyed.mapInArrow(functools.partial(_windows, register=r), "row_key string, anchor int, name string, written string") for r in registers]
    windows = functools.reduce(DataFrame.unionByName, found)
    windows = materialize(windows if len(found) == 1 else windows.distinct(), "windows")
    fields = fields.where("row_key is not null and name is not null").select("tbl", "row_key", "name").distinct()
    links = materialize(link_names(fields.select("name").unionByName(windows.select("name")), registers), "links")
    own = fields.join(links, "name").select("tbl", "row_key", "issuer", F.col("name").alias("written"), F.col("name").alias("core"), "ties")
    best = Window.partitionBy("row_key", "anchor").orderBy(F.desc(F.length("registered") + 2 * F.col("score")), F.length("written"), "written")
    inside = windows.join(links, "name").withColumn("place", F.dense_rank().over(best)).where("place = 1")
    parts = F.split("row_key", "\u0001")
    inside = inside.select(parts[0].alias("tbl"), parts[1].alias("row_key"), "issuer", "written", F.col("name").alias("core"), "ties")

    def plained(c):
        return F.trim(F.regexp_replace(F.translate(F.lower(F.col(c)), "ё", "е"), r"[^\p{L}\p{N}]+", " "))

    held = aliases.where("issuer is not null")
    listed = held.select("issuer", plained("issuer").alias("plain")).unionByName(held.where("alias is not null").select("issuer", plained("alias").alias("plain"))).distinct()
    listed = checked_broadcast(materialize(listed, "listed"))
    out = own.unionByName(inside).distinct().withColumn("__w", plained("written")).withColumn("__c", plained("core"))
    for c in ("__w", "__c"):
        out = out.join(listed.select("issuer", F.col("plain").alias(c), F.lit(True).alias(f"{c}_listed")), ["issuer", c], "left")
    out = out.groupBy("tbl", "row_key", "issuer", "written", (F.col("__w_listed").isNotNull() | F.col("__c_listed").isNotNull()).alias("listed")).agg(F.min("ties").alias("ties"))
    return out.select("tbl", "row_key", "issuer", "written", "listed", "ties")
