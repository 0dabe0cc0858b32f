"""Numbers, dates, labels and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A number written with comma or point and blanks between thousands; null if it is none."""
    return F.translate(F.trim(c), ",\u00a0 ", ".").try_cast("double")


def clamp01(c: Column, default: float = 0.0) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def non_negative(c: Column, default: float = 0.0) -> Column:
    return F.when(c >= 0, c).otherwise(F.lit(default))


def range_upper(c: Column, most: float = 1000.0) -> Column:
    """The upper end of the first range like '7,5-8.25' in a text whose ends do not exceed ``most``; null if there is none."""
    rx = r"(\d+(?:[.,]\d+)?)\s*(?:-|–|—|до)\s*(\d+(?:[.,]\d+)?)"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(rx), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(rx), F.lit(2)).alias("b"))
    ends = F.transform(pairs, lambda p: F.struct(F.translate(p["a"], ",", ".").cast("double").alias("lo"), F.translate(p["b"], ",", ".").cast("double").alias("hi")))
    good = F.filter(ends, lambda p: (p["lo"] <= most) & (p["hi"] <= most))
    return F.when(F.size(good) > 0, F.greatest(F.get(good, F.lit(0))["lo"], F.get(good, F.lit(0))["hi"]))


def positive_part(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def negative_part(c: Column) -> Column:
    return F.greatest(-c, F.lit(0))


# Spellings of a reviewer's yes and no.
YES, NO = ("1", "true", "yes", "y", "correct", "tp"), ("0", "false", "no", "n", "incorrect", "fp")


def label01(c: Column) -> Column:
    """A reviewer's label as 1, 0 or null."""
    s = F.lower(F.trim(c))
    return F.when(s.isin(*YES), 1).when(s.isin(*NO), 0)


def enum(c: Column, allowed: list[str], default: str) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*allowed), s).otherwise(F.lit(default))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def evidence(coefficient: Column, p: Column, expected: Column | str = "") -> Column:
    """What an estimate says about a hypothesis of sign ``expected`` ('positive', 'negative' or none): significant at ten percent, and in that direction."""
    want = F.lit(expected) if isinstance(expected, str) else expected
    known = coefficient.isNotNull() & p.isNotNull() & ~F.isnan(coefficient) & ~F.isnan(p)
    agrees = F.when(want == "positive", coefficient > 0).when(want == "negative", coefficient < 0)
    return F.when(~known, "not estimated").when(p >= 0.1, "no evidence").when(agrees.isNull(), "significant").when(agrees, "supports").otherwise("opposite sign")


def plain_dashes(c: Column) -> Column:
    """Long dashes as '-', trimmed."""
    return F.trim(F.translate(c, "–—", "--"))


def padded_id(c: Column, width: int = 10) -> Column:
    """The part before the first point, with zeros in front up to ``width``; longer ones stay."""
    head = F.substring_index(F.trim(c.cast("string")), ".", 1)
    return F.when(F.length(head) < width, F.lpad(head, width, "0")).otherwise(head)


def time_ago(c: Column, now: Column) -> Column:
    """'N minutes ago', 'N hours ago' before ``now`` (which is also 'just now'), or 'Oct 26, 2025, 11:56'; null for any other text."""
    s = F.lower(F.trim(c))
    count, unit = F.regexp_extract(s, r"^(\d+)\s+(minute|hour)s?\s+ago", 1).try_cast("int"), F.regexp_extract(s, r"^(\d+)\s+(minute|hour)s?\s+ago", 2)
    back = F.when(unit == "minute", F.make_interval(mins=count)).when(unit == "hour", F.make_interval(hours=count))
    return F.coalesce(now - back, F.when(s == "just now", now), F.try_to_timestamp(F.initcap(s), F.lit("MMM d, yyyy, HH:mm")))


def recovered_json(c: Column, schema: str) -> Column:
    """A JSON object read as it is, else from the first '{' to the last '}' of the text, else null."""
    whole = F.get_json_object(c, "$").isNotNull() & F.startswith(F.trim(c), F.lit("{"))
    return F.from_json(F.when(whole, c).otherwise(json_part(c, "{", "}")), schema)


def sorted_json(c: Column) -> Column:
    """A list as JSON text, sorted, each value once."""
    return F.to_json(F.array_sort(F.array_distinct(c)))


def percent(c: Column) -> Column:
    """A share as text in percent with one digit."""
    return F.concat(F.format_string("%.1f", c * 100), F.lit("%"))


def key_parts(c: Column) -> Column:
    """(source, local): what stands before and behind the first ':' of a key; the whole key is local if it has none."""
    at = F.instr(c, ":")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).alias("source"), F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c).alias("local"))


def period_days(c: Column, days: dict[str, int], default: int) -> Column:
    """The days a named period stands for."""
    out = F.lit(default)
    for name, n in days.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def month_before(c: Column) -> Column:
    """One calendar month earlier, clamped to the end of the month."""
    return F.add_months(c, -1)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(3_600_000_000.0)


def leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def century(y: Column) -> Column:
    return F.when(y > 0, F.floor((y - 1) / 100) + 1).otherwise(F.floor(F.abs(y) / 100) + 1).cast("bigint")


def era(y: Column) -> Column:
    return F.when(y > 0, "AD").otherwise("BC")


def json_strings(c: Column) -> Column:
    """A JSON list of strings; an empty list where it can't be read."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_part(c: Column, opening: str = "[", closing: str = "]") -> Column:
    """The text from the first ``opening`` to the last ``closing``, fences and prose around it aside; null if there is none."""
    return F.nullif(F.regexp_extract(c, rf"(?s)(\{opening}.*\{closing})", 1), F.lit(""))


def token_range(chars: Column) -> Column:
    """Least and most tokens to expect of so many characters."""
    return F.struct((chars / 4).alias("low"), (chars / 2.5).alias("high"))


def book_period(c: Column) -> Column:
    """First and last moment of a text with one or two 'dd.mm.yyyy (HH:MM)'; the last date is the first one's if missing."""
    rx = r"(\d{2}\.\d{2}\.\d{4})(?:\s*\(?(\d{1,2}:\d{2})\)?)?"
    d, t = F.regexp_extract_all(c, F.lit(rx), F.lit(1)), F.regexp_extract_all(c, F.lit(rx), F.lit(2))
    at = lambda i: F.try_to_timestamp(F.concat_ws(" ", F.get(d, F.lit(i)), F.coalesce(F.nullif(F.lpad(F.nullif(F.get(t, F.lit(i)), F.lit("")), 5, "0"), F.lit("")), F.lit("00:00"))), F.lit("dd.MM.yyyy HH:mm"))
    return F.struct(at(0).alias("first"), F.coalesce(F.when(F.size(d) > 1, at(1)), at(0)).alias("last"))
