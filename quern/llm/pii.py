"""Personal data in free text: found by a skip-chain conditional random field, replaced by typed placeholders.

Patterns propose candidate segments (e-mail, phone, identity number, street address, person, and surnames standing alone). The
variables of the field are the candidates of one text, each either of its kind or nothing; every other word can only be nothing,
which is what cuts the chain between them and keeps texts without candidates cheap. Potentials: features of the candidate and its
surroundings; a chain factor between neighbours; and skip factors between distant candidates that repeat or resemble each other
(the same surname stem, the same digits). Marginals come from loopy message passing. A bare surname tells little by itself: it
is labelled by its distant mates, a full name or a mention with a title elsewhere in the text.

The weights of the features, of the chain and of the skip factors are fitted together by pseudo-likelihood on a bounded sample of texts whose candidates are
labelled by their form alone where that leaves no doubt: positives (a check of digits beside its keyword, a full name with patronymic, a surname
that stands in a full name of the text) and negatives (amounts, numbers of companies and securities, names in quotation marks or beside a legal form). What
surrounds those teaches the context features that decide the others. The fit starts from prior weights and is drawn to them, so little data is no harm.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.names import LEGAL, LOOKALIKES, fold

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: A surname standing alone; replaced like a name, but no mention of the kind person_name, which has a given name or initials.
BARE = "surname"
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS} | {BARE: "[PERSON_NAME]"}
#: Texts of the sample the field is fitted on, the characters a text of the sample has at most, and passes over it.
SAMPLE_TEXTS, SAMPLE_CHARS, EPOCHS = 20_000, 10_000, 4
#: Rounds of message passing, and how far apart neighbours may be for a chain factor.
ROUNDS, CHAIN_REACH = 6, 40

# Given names, words of streets, of houses.
GIVEN = """александр алексей анатолий андрей антон аркадий артем артур богдан борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав
геннадий георгий герман глеб григорий даниил данила денис дмитрий евгений егор захар иван игорь илья кирилл константин лев леонид макар максим марат марк матвей михаил
назар никита николай олег павел петр роман руслан савелий семен сергей станислав степан тарас тимофей тимур федор филипп эдуард юрий яков ян ярослав
алена александра алина алиса алла анастасия ангелина анна антонина валентина валерия варвара василиса вера вероника виктория галина дарья диана ева евгения екатерина елена
елизавета жанна зинаида зоя инна ирина карина кира клавдия кристина ксения лариса лидия любовь людмила маргарита марина мария милана надежда наталья наталия нина оксана олеся
ольга полина раиса регина светлана софия софья таисия тамара татьяна ульяна юлия яна яна""".split()
GIVEN_ELSEWHERE = """john james robert michael william david richard thomas charles daniel paul mark george kevin brian peter mary jennifer linda susan jessica sarah karen emma laura
jean pierre michel jacques marie claire sophie francois hans klaus jurgen wolfgang stefan sabine ursula heike carlos jose juan luis miguel carmen lucia pablo mehmet mustafa ahmet ayse fatma emre
ахмед али мухаммед ильдар рустам айдар тагир нурлан ержан болат гульнара айгуль алия динара зарина олександр андрий дмитро сергий тетяна оксана""".split()
TITLES = "г-н г-жа г-на г-ну г-ном господин господина господину господином госпожа госпожи госпоже гражданин гражданина товарищ товарища тов мистер миссис директор директора аналитик аналитика менеджер менеджера нотариус mr mrs ms dr herr frau monsieur madame senor".split()
STREET_WORDS = "улица улице улицы ул проспект проспекте пр-т прт просп переулок переулке пер набережная набережной наб шоссе ш бульвар бульваре б-р бр площадь площади пл проезд проезде аллея тупик".split()
STREET_WORDS_ENGLISH = "street road avenue lane square drive boulevard court way st rd ave apt flat unit suite".split()
STREETS = "(?:" + "|".join(sorted(STREET_WORDS, key=len, reverse=True)) + ")"
HOUSE = r"(?:(?:дом|д)\.?\s*)?\d{1,4}(?:\s?[а-жА-Ж](?!\w))?(?:\s?[кk/]\s?\d{1,3})?"

_AT = r"(?:@|\s@\s|\s?[\[(](?:собака|at)[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(](?:точка|dot)[\])]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-zа-я][\w-]+", re.I)
_NUMBER = re.compile(r"(?<![\w@.,/-])(?:\+\s?)?\(?\d(?:(?:[  ().-]{0,3}|\s?(?:номер|№)\s?)\d){8,14}(?!\w)")
_MONTH = r"(?:янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек)"
_ADDRESS = re.compile(
    # a street with its name behind it: capitalised, or any word if the house is marked or a flat follows
    rf"(?<!\w)(?i:{STREETS})\.?\s+(?:[А-ЯЁ][\w-]+(?:\s[А-ЯЁ][а-яё]+)?,?\s*(?i:{HOUSE})|[\w-]+,?\s*(?i:(?:дом|д)\.?\s*{HOUSE}|{HOUSE},?\s*(?=кв|офис)))(?![\w%])(?!\s*(?i:{_MONTH}|млн|млрд|тыс|руб))"
    rf"|(?<!\w)(?i:[а-яё-]+(?:ая|ый|ий|ой|ое|ом))\s+(?i:{STREETS})\.?,?\s+(?i:{HOUSE})(?![\w%])(?!\s*(?i:{_MONTH}|млн|млрд|тыс|руб))"
    r"|(?<!\w)\d{1,4}\s(?:[A-Z][\w']*\s){1,3}(?:[A-Z][\w']*)(?=,?\s(?i:apt|flat|unit|suite)\b)|(?<!\w)\d{1,4}\s(?:[A-Z][\w']*\s){1,3}(?i:Street|Road|Avenue|Lane|Square|Drive|Boulevard|Court|Way|St|Rd|Ave)\b",
)
_INITIALS = re.compile(r"(?<!\w)[A-ZА-ЯЁ]\.")
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SURNAME = re.compile(r"^(?:[а-я]{2,}(?:ов|ев|ин|цин|цев|ск|цк))(?:а|у|им|ом|е|ои|ого|ому|их|ими|и|ая|ую)?$")
_PATRONYMIC = re.compile(r"^[а-я]{2,}(?:ович|евич|ьевич|овн|евн|иничн|ичн|ич)(?:а|у|ем|е|и|ои|ы)?$")
_KEYWORD = re.compile(r"(паспорт\w*|пасп\.?|снилс|инн\b|налогов\w+ номер|страхов\w+|passport|insurance)", re.I)
_PASSPORT, _SNILS = re.compile(r"пасп|passport", re.I), re.compile(r"снилс|страхов|insurance", re.I)
_COMPANY = re.compile(r"(эмитент|компани|организаци|выпуск|облигац|isin|номером|регистрац|ogrn|огрн)", re.I)
_MONEY = re.compile(r"^\s*(руб|тыс|млн|млрд|₽|\$|€|usd|бумаг|штук|лот)", re.I)
_TITLED = re.compile("(?<!\\w)(?i:" + "|".join(re.escape(t) for t in TITLES) + r")\.?\s+[A-ZА-ЯЁ]")
_STREET_SET, _TITLE_SET = frozenset((*STREET_WORDS, *STREET_WORDS_ENGLISH)), frozenset(TITLES)
_SINGLE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")


@dataclass
class Candidate:
    """A segment that may be personal data: its place, kind, features, keys of resemblance, and label if its form leaves no doubt."""

    start: int
    end: int
    kind: str
    features: list[str]
    keys: set[str] = field(default_factory=set)
    sure: int | None = None


def _script(word: str) -> str:
    """A lower-case word in Cyrillic letters, doubled letters kept."""
    if re.search("[a-z]", word) and re.search("[а-яё]", word):
        word = "".join(LOOKALIKES.get(c, c) for c in word)  # a Cyrillic word with Latin letters that look alike
    return "".join(fold(c) for c in re.findall(r"shch|zh|kh|ts|ch|sh|yu|ya|yo|.", word))


_CASE = re.compile("(?:ими|ого|ому|ой|ои|ом|им|их|ая|ую|ем|а|у|е|и|я|ю)$")


def _name_key(word: str) -> str:
    """What forms of one surname share: the word in one script without its ending; nothing for a word too short to tell."""
    w = fold(word.lower())
    short = _CASE.sub("", w)
    w = short if len(short) >= 5 else w
    return f"n:{w}" if len(w) >= 5 else ""


def _stem(name: str) -> str:
    return name[:-1] if name[-1] in "аяиьо" else name


_GIVEN = {_script(n) for n in (*GIVEN, *GIVEN_ELSEWHERE)}
_GIVEN_STEMS = {_stem(n) for n in _GIVEN}
_NAME_ENDINGS = ("а", "у", "ом", "ем", "е", "и", "ю", "я", "еи", "ои", "ы")


@functools.lru_cache(200_000)
def word_class(word: str) -> str:
    """g given name, p patronymic, s surname by its ending, - none; any script, case and grammatical case."""
    w = _script(word.lower())
    if w in _GIVEN or any(len(w) - k >= 3 and w[-k:] in _NAME_ENDINGS and w[:-k] in _GIVEN_STEMS for k in (1, 2)):
        return "g"
    if len(w) >= 6 and _PATRONYMIC.match(w):
        return "p"
    return "s" if len(w) >= 5 and _SURNAME.match(w) else "-"


def _around(text: str, start: int, end: int) -> list[str]:
    left = _TOKEN.findall(text[max(0, start - 40) : start].lower())[-3:]
    right = _TOKEN.findall(text[end : end + 25].lower())[:2]
    out = [f"l{i}={w[:6]}" for i, w in enumerate(reversed(left), 1)] + [f"r{i}={w[:6]}" for i, w in enumerate(right, 1)]
    before = text[:start].rstrip()
    return out + [f"lc={before[-1:] if before and not before[-1].isalnum() else ('^' if not before else 'w')}"]


def _number(text: str, m: re.Match, hard: bool = False) -> Candidate | None:
    s = m.group()
    digits = re.sub(r"\D", "", s)
    left = re.split(r"[\d\n;]", text[max(0, m.start() - 30) : m.start()])[-1]  # a keyword before another number belongs to that
    keyword = bool(_KEYWORD.search(left)) and not _COMPANY.search(left[_KEYWORD.search(left).start() :])
    money = bool(_MONEY.match(text[m.end() : m.end() + 8]))
    shape = re.sub(r"\d+", lambda x: str(len(x[0])), re.sub(r"\s*(?:номер|№)\s*", "#", s.strip()))
    shape = re.sub(r"[\s ]+", " ", shape)
    plus = s.lstrip("(").startswith("+")
    trunk = len(digits) == 11 and digits[0] in "78"
    base = [f"shape={shape}", f"n={len(digits)}", f"kw={keyword}", f"money={money}", *_around(text, m.start(), m.end())]
    if not keyword and (plus and 10 <= len(digits) <= 13 or trunk and digits[1] in "3489"):
        formed = bool(re.search(r"[()+]", s)) or shape in ("1-3-3-2-2", "1.3.3.2.2", "1 3 3 2 2", "11", "1 3 7")
        return Candidate(m.start(), m.end(), "phone", ["phone", f"plus={plus}", f"formed={formed}", *base], {"d:" + digits[-10:]}, 0 if money else 1 if formed and (plus or digits[1] == "9") else None)
    snils = len(digits) == 11 and (shape in ("3-3-3 2", "3-3-3-2", "3 3 3 2") or shape == "11" and bool(_SNILS.search(left)))
    passport = len(digits) == 10 and ("#" in shape or shape in ("4 6", "2 2 6") or shape == "10" and bool(_PASSPORT.search(left)))
    taxpayer = len(digits) == 12 and shape in ("12", "4 6 2", "3 3 3 3")
    if snils or passport or taxpayer:
        strict = shape in ("3-3-3 2", "3-3-3-2") or keyword and not money
        doubt = passport and not keyword
        return Candidate(m.start(), m.end(), "id_number", ["id", f"form={'snils' if snils else 'passport' if passport else 'tax'}", f"strict={strict}", f"doubt={doubt}", *base], {"d:" + digits}, 0 if money or _COMPANY.search(left[-15:]) else 1 if strict else None)
    if hard and 10 <= len(digits) <= 13:
        return Candidate(m.start(), m.end(), "id_number", ["id", "form=other", "strict=False", *base], {"d:" + digits}, 0)
    return None


def _of_organisation(text: str, start: int, end: int) -> bool:
    """Whether a segment stands in quotation marks or beside a legal form or a word like 'group'."""
    left, right = text[max(0, start - 25) : start], text[end : end + 15]
    before, after = _TOKEN.findall(left.lower()), _TOKEN.findall(right.lower())
    inside = left.count("«") > left.count("»") or left.rstrip()[-1:] in ("\"", "“", "„", "'")
    return inside or bool(before and before[-1] in LEGAL) or bool(after and after[0] in LEGAL)


def _more_persons(text: str, tokens: list[tuple[str, int, int]], found: list[Candidate]) -> list[Candidate]:
    """Candidates without a listed given name or initials: two capitalised words of which one has a surname's ending or that follow a title, and surnames standing alone."""
    taken, out = [(c.start, c.end) for c in found], []
    keys = {k for c in found for k in c.keys}
    free = [i for i, (w, s, e) in enumerate(tokens) if len(w) > 2 and w[0].isupper() and w[1:].islower() and not any(s < y and e > x for x, y in taken)]
    use = set(free)
    again: dict[str, int] = defaultdict(int)
    for i in free:
        again[_name_key(tokens[i][0])] += 1
    for i in free:
        if i not in use:
            continue
        w, start, end = tokens[i]
        cls, first = word_class(w), not text[:start].rstrip(" \u00a0(«\"").strip() or text[:start].rstrip()[-1:] in (".", "!", "?", "…", "\n", ":")
        title = i > 0 and tokens[i - 1][0].lower() in TITLES and re.fullmatch(r"\.?\s+", text[tokens[i - 1][2] : start]) is not None
        pair = i + 1 in use and re.fullmatch(r"[ \u00a0]", text[end : tokens[i + 1][1]]) is not None
        if pair:
            x = tokens[i + 1][0]
            ends = "".join("s" if c == "s" else "u" for c in (cls, word_class(x)))
            if ends != "uu" or title:
                stop = tokens[i + 1][2]
                org = _of_organisation(text, start, stop)
                use -= {i, i + 1}
                out.append(Candidate(start, stop, "person_name", ["person", f"form={ends}", f"title={title}", f"org={org}", f"first={first}", *_around(text, start, stop)], {_name_key(w if ends == "su" else x)} - {""}, 0 if org else None))
                continue
        key = _name_key(w)
        mate = key in keys
        # a surname's ending, a title or a mate in a full name make a word a candidate; else it can only be nothing
        if not key or cls in "gp" or not (mate or title or cls == "s" and (not first or again[key] > 1)):
            continue
        org = _of_organisation(text, start, end)
        sure = 0 if org and not mate else 1 if mate and not org and any(c.sure == 1 and key in c.keys for c in found) else None
        out.append(Candidate(start, end, BARE, ["bare", f"ending={cls == 's'}", f"title={title}", f"org={org}", f"first={first}", *_around(text, start, end)], {key}, sure))
    return out


def _persons(text: str) -> list[Candidate]:
    tokens = [(t.group(), t.start(), t.end()) for t in _TOKEN.finditer(text)]
    out: list[Candidate] = []
    i, n = 0, len(tokens)

    def near(a, b, gap=r"[  ]{1,2}"):
        return re.fullmatch(gap, text[tokens[a][2] : tokens[b][1]]) is not None

    def initial(a):
        return len(tokens[a][0]) == 1 and tokens[a][0].isupper() and text[tokens[a][2] : tokens[a][2] + 1] == "."

    def capital(a):
        return tokens[a][0][0].isupper()

    used = -1
    while i < n:
        w, start, end = tokens[i]
        cls = word_class(w) if len(w) > 1 else "i" if initial(i) else "-"
        span = None
        if cls == "g":
            a = b = i
            form = ["g"]
            if b + 1 < n and near(b, b + 1) and word_class(tokens[b + 1][0]) == "p":
                b += 1
                form.append("p")
            def family(k, gap):
                """s: the word beside the name has a surname's ending, x: it may be one, none: it can't."""
                if not 0 <= k < n or k <= used or not near(*gap) or len(tokens[k][0]) < 3:
                    return ""
                x = tokens[k][0]
                if word_class(x) == "s":
                    return "s"
                like = (x.isupper() == w.isupper() and capital(k) == capital(i)) and x.lower() not in LEGAL and not _KEYWORD.match(x) and word_class(x) == "-"
                return "x" if like and len(x) > 4 and (capital(i) or k > i) else ""

            behind, ahead = family(b + 1, (b, b + 1)), family(a - 1, (a - 1, a))
            if behind and not (ahead == "s" and behind == "x"):
                b += 1
                form.append(behind)
            elif ahead:
                a -= 1
                form.insert(0, ahead)
            if len(form) > 1:
                span = a, b, "".join(form)
        elif cls == "i" and not (start and (text[start - 1].isalnum() or text[start - 1] in ".-")):
            b = i
            while b + 1 < n and initial(b + 1) and near(b, b + 1, r"\.[  ]?"):
                b += 1
            count = b - i + 1
            shout = i > 0 and len(tokens[i - 1][0]) > 2 and tokens[i - 1][0].isupper()
            after = tokens[b + 1][0] if b + 1 < n else ""
            if i - 1 > used and near(i - 1, i, r",?[ \u00a0]{1,2}") and capital(i - 1) and word_class(tokens[i - 1][0]) == "s" and word_class(after) != "s":
                span = i - 1, b, "s" + "i" * count
            elif len(after) > 3 and near(b, b + 1, r"\.[ \u00a0]?") and after[0].isupper() and (word_class(after) == "s" or not shout and not after.isupper()):
                span = i, b + 1, "i" * count + ("s" if word_class(tokens[b + 1][0]) == "s" else "x")
            elif i - 1 > used and near(i - 1, i, r",?[  ]{1,2}") and len(tokens[i - 1][0]) > 3 and capital(i - 1):
                prev = word_class(tokens[i - 1][0])
                if prev == "s" or count > 1 or "," in text[tokens[i - 1][2] : start] and len(tokens[i - 1][0]) > 4:
                    span = i - 1, b, ("s" if prev == "s" else "x") + "i" * count
        if span:
            a, b, form = span
            words = [tokens[k][0] for k in range(a, b + 1)]
            key = next((_name_key(x) for x, f in zip(words, form) if f in "sx"), "")
            s, e = tokens[a][1], tokens[b][2] + (form.endswith("i"))
            case = "upper" if all(x.isupper() for x in words) else "lower" if all(x.islower() for x in words) else "title"
            sure = 1 if "p" in form and "s" in form and case != "lower" else 1 if form in ("gs", "sg") and case == "title" and re.search("[а-яё]", words[0]) else None
            out.append(Candidate(s, e, "person_name", ["person", f"form={form}", f"case={case}", f"lowx={case == 'lower' and 'x' in form}", f"whole={s == 0 and e >= len(text.rstrip())}", f"comma={',' in text[s:e]}", *_around(text, s, e)], {key} - {""}, sure))
            used = b
            i = b + 1
            continue
        i += 1
    return out + _more_persons(text, tokens, out)


_seen: set[str] = set()
_given: set[str] = set()


def may_name(words: set[str]) -> bool:
    """Whether one of the words is a given name; what was asked before is remembered."""
    new = words - _seen
    if new:
        if len(_seen) > 500_000:
            _seen.clear()
        _seen.update(new)
        _given.update(w for w in new if len(w) > 1 and word_class(w) == "g")
    return not _given.isdisjoint(words)


def candidates(text: str | None, hard: bool = False) -> list[Candidate]:
    """The candidate segments of a text in order, without overlaps (an e-mail over a phone, over a number, an address, a name).

    ``hard`` adds numbers that can't be personal data, as negatives for the fit.
    """
    if not text:
        return []
    out: list[Candidate] = []
    if "@" in text or "[" in text or "(" in text:
        for m in _EMAIL.finditer(text):
            spaced = " " in m.group()
            out.append(Candidate(m.start(), m.end(), "email", ["email", f"spaced={spaced}", f"tld={m.group().rsplit('.', 1)[-1].isalpha()}", *_around(text, m.start(), m.end())], {"e:" + m.group().lower()}, None if spaced else 1))
    # cheap tests first: most texts have neither nine digits nor a word of a street, a title, an initial or a given name
    if sum(map(text.count, "0123456789")) >= 9:
        for m in _NUMBER.finditer(text):
            if c := _number(text, m, hard):
                out.append(c)
    tokens = set(_TOKEN.findall(text))
    low = set(map(str.lower, tokens))
    if "-" in text:
        low.update(x for w in tuple(low) if "-" in w for x in w.split("-"))
    if not _STREET_SET.isdisjoint(low):
        for m in _ADDRESS.finditer(text):
            flat = bool(re.match(r",?\s*(?:кв|квартира|офис|apt|корп|к\.|стр)", text[m.end() : m.end() + 12], re.I))
            out.append(Candidate(m.start(), m.end(), "address", ["address", f"flat={flat}", f"capital={m.group()[0].isupper()}", *_around(text, m.start(), m.end())], {"a:" + re.sub(r"\W", "", m.group().lower())}, 1 if flat else None))
    if not _SINGLE.isdisjoint(tokens) and _INITIALS.search(text) or not _TITLE_SET.isdisjoint(low) and _TITLED.search(text) or may_name(low):
        out += _persons(text)
    rank = {k: i for i, k in enumerate((*KINDS, BARE))}
    kept: list[Candidate] = []
    for c in sorted(out, key=lambda c: (rank[c.kind], c.start)):
        if all(c.end <= k.start or c.start >= k.end for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: c.start)


PRIOR = {"phone": 1.5, "formed=True": 1.0, "id": 0.5, "strict=True": 2.0, "doubt=True": -2.5, "money=True": -5.0, "email": 2.0, "tld=False": -3.0, "address": 1.5, "flat=True": 1.0, "person": 0.5, "form=gx": -1.0, "form=xg": -1.5, "form=ix": -2.5, "form=xi": -3.0, "form=xii": -1.5, "form=iix": -0.5, "form=xgp": 0.5, "lowx=True": -2.0, "whole=True": 1.5, "comma=True": 1.0, "form=us": -1.5, "form=su": -2.0, "form=uu": -2.5, "title=True": 2.5, "org=True": -3.0, "first=True": -0.3, "bare": -1.0, "ending=True": 0.6}


class SkipChainCRF:
    """Weights of features, of the chain and of the skip factors; a factor's weight is the score two equal labels have over two different ones."""

    def __init__(self, weights: dict[str, float] | None = None, chain: float = 0.2, skip: float = 1.5):
        self.weights, self.chain, self.skip = dict(PRIOR) | (weights or {}), chain, skip

    def edges(self, cs: list[Candidate]) -> list[tuple[int, int, float]]:
        """Chain factors between neighbours; skip factors of each candidate with the mate before it and with the one of its mates that its own features tell best."""
        out = [(i, i + 1, self.chain) for i in range(len(cs) - 1) if cs[i + 1].start - cs[i].end <= CHAIN_REACH]
        mates: dict[str, list[int]] = defaultdict(list)
        for i, c in enumerate(cs):
            for k in c.keys:  # keys tell names, digits and addresses apart, so mates are of like kinds
                mates[k].append(i)
        skips = set()
        for of in mates.values():
            if len(of) > 1:
                best = max(of, key=lambda i: (self.unary(cs[i]), -i))
                skips.update(zip(of, of[1:]))
                skips.update((min(i, best), max(i, best)) for i in of if i != best)
        return out + [(i, j, self.skip) for i, j in sorted(skips)]

    def unary(self, c: Candidate) -> float:
        w = self.weights
        return sum(w.get(f"{c.kind}|{f}", w.get(f, 0.0)) for f in c.features)

    def marginals(self, cs: list[Candidate], rounds: int = ROUNDS) -> list[float]:
        """The probability of each candidate to be of its kind, by loopy sum-product (exact where the graph is a tree)."""
        theta = [self.unary(c) for c in cs]
        edges = self.edges(cs)
        if not edges:
            return [1 / (1 + math.exp(-max(-30, min(30, t)))) for t in theta]
        links: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for e, (i, j, w) in enumerate(edges):
            links[i].append((j, 2 * e, w))
            links[j].append((i, 2 * e + 1, w))
        # messages are log-odds; message 2e goes from the edge's first node, 2e+1 from its second
        message = [0.0] * (2 * len(edges))
        for _ in range(min(rounds, len(cs) + 1)):
            fresh = message[:]
            for i, around in links.items():
                total = theta[i] + sum(message[k ^ 1] for _, k, _ in around)
                for _, k, w in around:
                    t = max(-30.0, min(30.0, total - message[k ^ 1]))
                    fresh[k] = math.log((math.exp(t + w) + 1) / (math.exp(t) + math.exp(w)))
            message = fresh
        out = []
        for i, t in enumerate(theta):
            t += sum(message[k ^ 1] for _, k, _ in links.get(i, ()))
            out.append(1 / (1 + math.exp(-max(-30, min(30, t)))))
        return out

    def fit(self, texts: list[list[Candidate]], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 0.002, seed: int = 5) -> SkipChainCRF:
        """Pseudo-likelihood over the candidates whose label is sure, by AdaGrad, drawn to the prior weights; the factors' weights stay at 0 or more."""
        texts = [t for t in texts if any(c.sure is not None for c in t)]
        squares: dict[str, float] = defaultdict(float)
        prior = dict(self.weights)
        factors, start = {"chain": self.chain, "skip": self.skip}, {"chain": self.chain, "skip": self.skip}
        learned = {k for k, v in factors.items() if v > 0}  # a factor that is switched off stays so
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(texts)):
                cs = texts[k]
                guess = [c.sure if c.sure is not None else float(self.unary(c) > 0) for c in cs]
                near: dict[int, dict[str, float]] = defaultdict(lambda: {"chain": 0.0, "skip": 0.0})
                chained = sum(1 for i in range(len(cs) - 1) if cs[i + 1].start - cs[i].end <= CHAIN_REACH)
                for e, (i, j, _) in enumerate(self.edges(cs)):
                    name = "chain" if e < chained else "skip"
                    near[i][name] += 2 * guess[j] - 1
                    near[j][name] += 2 * guess[i] - 1
                for i, c in enumerate(cs):
                    if c.sure is None:
                        continue
                    # what makes the label sure is hidden half of the time, so that the surroundings learn to tell
                    names = [f"{c.kind}|{f}" for f in c.features if f[:2] in ("l1", "l2", "l3", "r1", "r2", "lc") or f.startswith(("money", "kw")) or order.random() < 0.5]
                    mates = near[i] if i in near else {}
                    t = sum(self.weights.get(f, self.weights.get(f.split("|", 1)[1], 0.0)) for f in names) + sum(factors[f] * v for f, v in mates.items())
                    g = 1 / (1 + math.exp(-max(-30, min(30, t)))) - c.sure
                    for f in names:
                        old = self.weights.get(f, prior.get(f.split("|", 1)[1], 0.0))
                        squares[f] += g * g
                        self.weights[f] = old - rate * g / math.sqrt(squares[f] + 1e-6) - decay * (old - prior.get(f.split("|", 1)[1], 0.0))
                    for f, v in mates.items():
                        if f in learned and v:
                            squares[f] += (g * v) ** 2
                            factors[f] = max(0.0, factors[f] - rate * g * v / math.sqrt(squares[f] + 1e-6) - decay * (factors[f] - start[f]))
                self.chain, self.skip = factors["chain"], factors["skip"]
        return self

    def mentions(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, probability) of each mention in a text, in order."""
        cs = candidates(text)
        if not cs:
            return []
        return [(c.start, c.end, c.kind, p) for c, p in zip(cs, self.marginals(cs)) if p >= 0.5]


def redact(text: str | None, mentions: list[tuple[int, int, str, float]]) -> str | None:
    """The text with each mention replaced by the placeholder of its kind; all else is kept."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind, _ in mentions:
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join(out) + text[at:]


def fit_on(texts: DataFrame, limit: int = SAMPLE_TEXTS) -> SkipChainCRF:
    """A field fitted on at most ``limit`` distinct texts with candidates, those of up to SAMPLE_CHARS characters with the least hashes: the same on every run."""
    rows = texts.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("text")
    total = rows.count()
    part = min(1.0, 4 * limit / max(total, 1))
    rank = F.xxhash64("text")
    picked = rows.where(F.pmod(rank, F.lit(1_000_003)) < F.lit(int(part * 1_000_003) + 1)).distinct()

    def only_candidates(batches):
        for b in batches:
            yield pa.record_batch({"text": pa.array([t for t in b.column("text").to_pylist() if candidates(t, True)], pa.string())})

    held = picked.mapInArrow(only_candidates, "text string")
    sample = sorted(r[0] for r in held.orderBy(rank, "text").limit(limit).collect())
    return SkipChainCRF().fit([candidates(t, True) for t in sample])


def find_mentions(texts: DataFrame, model: SkipChainCRF) -> DataFrame:
    """(tbl, row_key, kind, nth, first, length, probability) of the mentions in texts (tbl, row_key, text); nth counts by kind from 1.

    ``first`` is the place of the first character, from 0. Kinds are those of KINDS, and BARE for surnames standing alone. Null and
    empty texts have none; repeated rows repeat theirs.
    """
    known = texts.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        for b in batches:
            rows = []
            for tbl, key, text in zip(*(b.column(c).to_pylist() for c in ("tbl", "row_key", "text"))):
                count: dict[str, int] = defaultdict(int)
                for s, e, kind, p in known.value.mentions(text):
                    count[kind] += 1
                    rows.append((tbl, key, kind, count[kind], s, e - s, p))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tbl", "row_key", "kind", "nth", "first", "length", "probability"])

    return texts.where("text is not null").select("tbl", "row_key", "text").mapInArrow(find, "tbl string, row_key string, kind string, nth bigint, first bigint, length bigint, probability double")


def redact_texts(texts: DataFrame, model: SkipChainCRF) -> DataFrame:
    """(tbl, row_key, text): every row of ``texts`` with its mentions replaced; null texts stay null."""
    known = texts.sparkSession.sparkContext.broadcast(model)

    def change(batches):
        for b in batches:
            new = [redact(t, known.value.mentions(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"tbl": b.column("tbl"), "row_key": b.column("row_key"), "text": pa.array(new, pa.string())})

    return texts.select("tbl", "row_key", "text").mapInArrow(change, "tbl string, row_key string, text string")
