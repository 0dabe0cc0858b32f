"""Text functions as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replies that say nothing by themselves.
LOW_INFO_REPLIES = ("+", "++", "ага", "угу", "ок", "окей", "да", "нет", "согласен", "не согласен", "норм", "лол", "жесть", "имхо", "ясно", "понятно", "спасибо", "thanks")
TOKEN = r"[a-zа-я0-9]+(?:[-.][a-zа-я0-9]+)*"
# Cyrillic capitals and the Latin ones that look alike.
HOMOGLYPHS = ("АВЕКМНОРСТХУ", "ABEKMHOPCTXY")


def squeeze(c: Column) -> Column:
    """White space (also the no-break space) as single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def normalize_match_text(c: Column) -> Column:
    """Text as alias matching reads it: lower case, ё as е, dashes as '-', only letters, digits, '-' and '.'; null as ''."""
    s = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё—–", "е--")
    return F.trim(F.regexp_replace(s, r"[^a-zа-я0-9\-.]+", " "))


def normalize_mining_text(c: Column) -> Column:
    """Text as alias mining reads it: lower case, ё as е, dashes as '-', blanks squeezed."""
    return squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё—–", "е--"))


def tokens(c: Column) -> Column:
    """Tokens of an already normalised text, inner '-' and '.' kept."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, shortest first, in order of the text. ``toks`` should be a stored column: it is read for each n-gram."""
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(toks, i, n)))
        return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def says_little(c: Column) -> Column:
    """Whether a reply is too short to tell its subject: nothing is left of it, it has two tokens at most, or it is a stock reply."""
    t = normalize_match_text(c)
    return (F.size(tokens(t)) < 3) | t.isin("", *LOW_INFO_REPLIES)


# What the cleaning of short posts takes out, in order, and by what it is replaced. W stands for letters, digits and '_', S for white space.
CLEANING = [(r"https?://[^S]+|www\.[^S]+", ""), (r"<[^>]+>", ""), (r"[^S]+@[^S]+", ""), (r"@[W]+", ""), (r"#[W]+", ""), (r"(?<![W])rt(?![W])", ""), (r"\p{Nd}+", ""), (r"[^WS]", " "), (r"[^\x00-\x7F]", "")]


def clean_post(c: Column) -> Column:
    """The cleaning chain of short posts: lower case; links, tags, addresses, mentions, hashtags, 'rt' and digits out, punctuation as blanks, other than ASCII out, blanks squeezed."""
    s = F.lower(c)
    for rx, by in CLEANING:
        s = F.regexp_replace(s, rx.replace("W", r"\p{L}\p{N}_").replace("S", r"\s\p{Z}\x{85}"), by)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def remove_words(toks: Column, words: list[str]) -> Column:
    """The tokens that are none of the words, in order."""
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def pattern_flag(c: Column, pattern: str) -> Column:
    """(flag, first): whether a pattern occurs, letter case aside, and the first text it matches (null if none)."""
    hit = F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iu)({pattern})", 1)
    return F.struct((hit != "").alias("flag"), F.nullif(hit, F.lit("")).alias("first"))


def stem_near(toks: Column, start: Column, end: Column, stems: list[str], left: int, right: int) -> Column:
    """Whether a token from ``left`` before to ``right`` behind the span [start, end) (from 0) begins with one of the stems."""
    low = F.greatest(start - left, F.lit(0))
    window = F.slice(toks, low + 1, F.least(F.size(toks), end + right) - low)
    begins = lambda t: functools.reduce(lambda x, y: x | y, [F.startswith(t, F.lit(s)) for s in stems])
    return F.exists(window, begins)


def strip_html(c: Column) -> Column:
    """Text of a fragment: tags out, common entities read, blanks squeezed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return squeeze(s)


def homoglyph_key(c: Column) -> Column:
    """Upper case, Cyrillic look-alikes as Latin, only letters and digits."""
    return F.regexp_replace(F.translate(F.upper(c), *HOMOGLYPHS), r"[^0-9A-ZА-Я]", "")


def issue_number(c: Column) -> Column:
    """What stands behind the first comma, trimmed; null if there is none."""
    return F.when(F.instr(c, ",") > 0, F.trim(F.regexp_extract(c, r"^[^,]*,(.*)$", 1)))


def contains_key(hay: Column, needle: Column) -> Column:
    """Whether the normalised needle, if any, is part of the normalised text."""
    n = homoglyph_key(needle)
    return (n != "") & F.contains(homoglyph_key(hay), n)


def flag_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, letter case aside; null texts have none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def near_context(c: Column, a: str, b: str, reach: int = 280) -> Column:
    """Whether patterns a and b occur at most ``reach`` characters apart, in either order."""
    return F.lower(c).rlike(f"(?s)(?:{a}).{{0,{reach}}}(?:{b})|(?:{b}).{{0,{reach}}}(?:{a})")


def snippet(c: Column, pattern: str, radius: int = 220) -> Column:
    """The text up to ``radius`` characters around the first match; null if there is none."""
    hit = F.regexp_extract(F.lower(c), f"(?s)^(.*?)({pattern})", 1)
    return F.when(F.lower(c).rlike(pattern), squeeze(F.substring(c, F.greatest(F.length(hit) + 1 - radius, F.lit(1)), F.lit(2 * radius))))
