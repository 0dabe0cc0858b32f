"""Timestamps of mixed formats, precisions and zones as one UTC instant.

Texts are parsed column-wise (no Python in the row path) into a local wall time plus, where one is
written, an offset or a zone. Wall times without an offset meet the exploded offset intervals of
their zone in an as-of join: one matching interval gives the offset, two mean an ambiguous time
(the clock shows it twice), none means a time the clock skips.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.scale import checked_broadcast

DAY_US = 86_400_000_000
#: Width of the local-time buckets into which offset intervals are exploded.
BUCKET_US = 32 * DAY_US
#: Offset intervals are known for these years; a zoned wall time outside them matches none.
YEARS = (1900, 2100)

# Month names (Russian and English, as first letters) and zone abbreviations.
MONTHS = [
    ("янв", 1), ("фев", 2), ("мар", 3), ("апр", 4), ("май", 5), ("мая", 5), ("июн", 6), ("июл", 7), ("авг", 8), ("сен", 9), ("окт", 10), ("ноя", 11), ("дек", 12),
    ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("may", 5), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("oct", 10), ("nov", 11), ("dec", 12),
]
ABBREVIATION_MINUTES = {"z": 0, "utc": 0, "gmt": 0, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
ABBREVIATION_ZONES = {"мск": "Europe/Moscow", "msk": "Europe/Moscow"}
DAY_WORDS = {"сегодня": 0, "today": 0, "вчера": 1, "yesterday": 1, "позавчера": 2}

_TIME = r"^(?:в |at )?(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?: ?(am|pm))?(?: ?\(?((?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|[a-zа-я]{1,5})\)?)?$"


#: A text that names a day and nothing else; the time then stands apart.
_BARE_DAY = r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})(?: ?г\.?)?|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} [а-яёa-z]+\.? \d{4}(?: г\.?)?|сегодня|вчера|позавчера|today|yesterday)$"


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


#: Date shapes and the canonical head "form|year|month|day|rest" each is rewritten to.
_FORMS = [
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[t ](.*))?$", "i|$1|$2|$3|$4"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?: (.*))?$", "i|$1|$2|$3|$4"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?: ?г\.?)?(?:,? (.*))?$", "i|$3|$2|$1|$4"),
    (r"^(\d{1,2})\.(\d{1,2})\.([0-6]\d)(?:,? (.*))?$", "i|20$3|$2|$1|$4"),
    (r"^(\d{1,2})\.(\d{1,2})\.([7-9]\d)(?:,? (.*))?$", "i|19$3|$2|$1|$4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,? (.*))?$", "u|$3|$1|$2|$4"),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(z?)$", "i|$1|$2|$3|$4:$5:$6$7"),
    (r"^(?:[a-z]{3}, )?(\d{1,2}) ([а-яёa-z]{3})[а-яёa-z]*\.? (\d{4})(?: г\.?)?(?:,? (.*))?$", "n|$3|$2|$1|$4"),
    (r"^(сегодня|вчера|позавчера|today|yesterday)(?:,? (.*))?$", "r|$1|||$2"),
]


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s\u00a0]+", " ")


def _head(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for rx, to in reversed(_FORMS):
        out = F.when(x.rlike(rx), F.regexp_replace(x, rx, to)).otherwise(out)
    return out


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _with_day(df: DataFrame, text: Column, base: Column | None) -> DataFrame:
    """Add __h (head fields) and __day to ``df``; staged so that each expression is evaluated once."""
    df = df.withColumn("__s", _normal(text)).withColumn("__h", F.split(_head(F.col("__s")), r"\|", 5))
    h = [F.get(F.col("__h"), F.lit(i)) for i in range(5)]
    month = F.when(h[0] == "n", F.coalesce(_map({k: str(v) for k, v in MONTHS})[h[2]], F.lit("0"))).otherwise(h[2])
    df = df.withColumn("__first", F.when(h[0] != "r", _date(h[1], month, h[3])))
    df = df.withColumn("__second", F.when(h[0] == "u", _date(h[1], h[3], h[2])))
    one, two = F.col("__first"), F.col("__second")
    slashed = F.when(h[4].rlike(r"[ap]m\b") | two.isNull() | (one == two), one).when(one.isNull(), two)
    back = _map(DAY_WORDS)[h[1]].cast("int")
    relative = F.date_sub(base, back) if base is not None else F.lit(None).cast("date")
    return df.withColumn("__day", F.when(h[0] == "r", relative).when(h[0] == "u", slashed).otherwise(one))


def parse_wall_time(df: DataFrame, text: str, out: str, base_day: str | None = None) -> DataFrame:
    """Add ``out``: struct(day date, time_us bigint, offset_min int, zone string, utc_us bigint, bare_day boolean).

    ``utc_us`` is set for epoch seconds or milliseconds only. ``day`` or ``time_us`` is null where the text
    does not name it or names an impossible one; an unknown zone word makes both null. ``bare_day``: the text has a day
    and nothing after it. Days named relative to the collection count
    back from the date in ``base_day``. Slashed dates with the year last are month first when AM/PM
    follows; without it they count only if one reading is possible. Two-digit years are 20yy. Parts that are not
    written are zero.
    """
    columns = df.columns
    base = F.col(base_day) if base_day else None
    df = _with_day(df, F.col(text), base)
    dated = F.col("__h").isNotNull()
    df = df.withColumn("__rest", F.when(dated, F.nullif(F.get(F.col("__h"), F.lit(4)), F.lit(""))).otherwise(F.col("__s")))
    df = df.withColumn("__t", F.split(F.when(F.col("__rest").rlike(_TIME), F.regexp_replace(F.col("__rest"), _TIME, "$1|$2|$3|$4|$5|$6")), r"\|"))
    t = [F.get(F.col("__t"), F.lit(i)) for i in range(6)]
    half, hour, minute, second = t[4], t[0].cast("int"), t[1].cast("int"), F.coalesce(F.nullif(t[2], F.lit("")).cast("int"), F.lit(0))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    micros = F.rpad(t[3], 6, "0").cast("bigint")
    good = hour24.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    time_us = F.when(good, ((hour24.cast("bigint") * 60 + minute) * 60 + second) * 1_000_000 + micros)
    df = df.withColumn("__w", F.regexp_replace(F.nullif(t[5], F.lit("")), r"^(?:utc|gmt)([+-])", "$1"))
    word = F.col("__w")
    signed = word.rlike(r"^[+-]")
    digits = F.rpad(F.regexp_replace(word, r"\D", ""), 4, "0")
    minutes = (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")) * F.when(word.startswith("-"), -1).otherwise(1)
    df = df.withColumn("__offset", F.when(signed, minutes).otherwise(_map(ABBREVIATION_MINUTES)[word]).cast("int")).withColumn("__zone", F.when(~signed, _map(ABBREVIATION_ZONES)[word]))
    known = word.isNull() | F.col("__offset").isNotNull() | F.col("__zone").isNotNull()
    s = F.col("__s")
    epoch = F.when(s.rlike(r"^\d{10}$"), s.cast("bigint") * 1_000_000).when(s.rlike(r"^\d{13}$"), s.cast("bigint") * 1_000)
    parsed = F.struct(
        F.when(known, F.col("__day")).alias("day"),
        F.when(known, time_us).alias("time_us"),
        F.col("__offset").alias("offset_min"),
        F.col("__zone").alias("zone"),
        epoch.alias("utc_us"),
        (dated & F.col("__rest").isNull()).alias("bare_day"),
    )
    return df.select(*[F.col(f"`{c}`") for c in columns if c != out], parsed.alias(out))


def zone_intervals(zones: list[str], years: tuple[int, int] = YEARS) -> list[tuple[str, int, list[tuple[int, int, int]]]]:
    """Offset intervals of each zone in local time, exploded to buckets: (zone, bucket, [(lo, hi, offset_us)]).

    An interval covers the wall times lo <= t < hi (microseconds since 1970 as if UTC) that its offset yields.
    """
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first, last = (datetime(y, 1, 1, tzinfo=timezone.utc) for y in years)
    out: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for name in zones:
        tz = ZoneInfo(name)
        offset = lambda at: int(at.astimezone(tz).utcoffset().total_seconds())  # noqa: B023, E731
        pieces, start, now = [], first, offset(first)
        at = first
        while at < last:
            step = min(at + timedelta(days=3), last)
            if offset(step) != now:
                lo, hi = at, step
                while hi - lo > timedelta(seconds=1):
                    mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                    lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
                pieces.append((start, hi, now))
                start, now = hi, offset(hi)
                step = hi
            at = step
        pieces.append((start, last, now))
        for a, b, off in pieces:
            lo, hi = (int((x - epoch).total_seconds() + off) * 1_000_000 for x in (a, b))
            for bucket in range(lo // BUCKET_US, (hi - 1) // BUCKET_US + 1):
                out.setdefault((name, bucket), []).append((lo, hi, off * 1_000_000))
    return [(z, k, v) for (z, k), v in out.items()]


def interval_table(spark: SparkSession, zones: list[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """:func:`zone_intervals` as a DataFrame (at most about 2,300 rows a zone)."""
    return spark.createDataFrame(zone_intervals(zones, years), "zone string, bucket bigint, spans array<struct<lo bigint, hi bigint, off bigint>>")


def resolve_utc(df: DataFrame, intervals: DataFrame, parsed: str, home_zone: str, out: str = "utc_us") -> DataFrame:
    """Add ``out`` (UTC microseconds or null) and ``out + '_status'`` to ``df``.

    ``parsed`` holds :func:`parse_wall_time`'s struct, ``home_zone`` the zone of times written without one (null:
    unknown). Status: ``ok``, ``ambiguous``, ``nonexistent``, ``no_zone``, ``no_time``. Rows are neither lost nor repeated.
    """
    p = F.col(parsed)
    local = F.unix_date(p["day"]).cast("bigint") * DAY_US + p["time_us"]
    df = df.withColumn("__local", local).withColumn("__zone", F.when(p["offset_min"].isNull() & p["utc_us"].isNull() & local.isNotNull(), F.coalesce(p["zone"], F.col(home_zone))))
    df = df.withColumn("__bucket", F.when(F.col("__zone").isNotNull(), F.floor(F.col("__local") / BUCKET_US)))
    spans = intervals.select(F.col("zone").alias("__iz"), F.col("bucket").alias("__ib"), F.col("spans").alias("__spans"))
    df = df.join(checked_broadcast(spans), (F.col("__zone") == F.col("__iz")) & (F.col("__bucket") == F.col("__ib")), "left")
    hits = F.filter(F.coalesce(F.col("__spans"), F.array().cast("array<struct<lo:bigint,hi:bigint,off:bigint>>")), lambda x: (x["lo"] <= F.col("__local")) & (F.col("__local") < x["hi"]))
    df = df.withColumn("__hits", F.when(F.col("__zone").isNotNull(), hits))
    n = F.size("__hits")
    status = (
        F.when(p["utc_us"].isNotNull() | (p["offset_min"].isNotNull() & F.col("__local").isNotNull()), "ok")
        .when(F.col("__local").isNull(), "no_time")
        .when(F.col("__zone").isNull(), "no_zone")
        .when(n == 1, "ok").when(n == 0, "nonexistent").otherwise("ambiguous")
    )
    utc = F.coalesce(
        p["utc_us"],
        F.col("__local") - p["offset_min"].cast("bigint") * 60_000_000,
        F.when(n == 1, F.col("__local") - F.get(F.col("__hits"), F.lit(0))["off"]),
    )
    return df.withColumn(out, utc).withColumn(f"{out}_status", status).drop("__local", "__zone", "__bucket", "__iz", "__ib", "__spans", "__hits")


#: More home zones than the IANA list has are an error.
MOST_ZONES = 1000


def feed_zones(feeds: DataFrame) -> list[str]:
    """The distinct home zones of ``feeds``; their number is bounded by the IANA list of zones, more than MOST_ZONES are an error."""
    rows = feeds.select("home_zone").where(F.col("home_zone").isNotNull()).distinct().limit(MOST_ZONES + 1).collect()
    if len(rows) > MOST_ZONES:
        raise ValueError(f"over {MOST_ZONES} home zones")
    return sorted({r[0] for r in rows} | set(ABBREVIATION_ZONES.values()))


def publication_instants(messages: DataFrame, posts: DataFrame, articles: DataFrame, feeds: DataFrame, forum: str = "smartlab") -> DataFrame:
    """(tbl, row_key, written, utc_us, utc_us_status): every message, post and article with its instant or null.

    Times without a zone run on the home clock of the row's feed. ``collected_at`` / ``fetched_at`` (ISO, UTC) is the
    base of relative days, on the feed's clock. A feed listed with several zones has no known clock. Rows of one key are kept apart; null keys yield a null ``row_key``.
    """
    spark = feeds.sparkSession
    spans = interval_table(spark, feed_zones(feeds))
    home = feeds.where("feed is not null").groupBy(F.col("feed").alias("__feed")).agg(F.min("home_zone").alias("__home"), F.max("home_zone").alias("__other"))
    home = checked_broadcast(home.select("__feed", F.when(F.col("__home") == F.col("__other"), F.col("__home")).alias("__home")))

    def local_day(at: str) -> Column:
        return F.date_from_unix_date(F.floor(F.unix_micros(F.from_utc_timestamp(F.try_to_timestamp(F.col(at)), F.coalesce(F.col("__home"), F.lit("UTC")))) / DAY_US).cast("int"))

    m = messages.select(F.lit("messages").alias("tbl"), F.concat("channel", F.lit(":"), F.col("id").cast("string")).alias("row_key"), F.col("channel").alias("__key"), F.col("date").alias("written"), F.col("date").alias("__text"), F.lit(None).cast("string").alias("__at"))
    p = posts.select(F.lit("posts").alias("tbl"), F.col("post_id").alias("row_key"), F.lit(forum).alias("__key"), F.col("published_at").alias("written"), F.col("published_at").alias("__text"), F.col("collected_at").alias("__at"))
    day, label = F.coalesce("date_time", "date_label"), F.coalesce("time_label", F.lit(""))
    whole = F.when(F.col("date_time").isNull() | F.lower(F.trim("date_time")).rlike(_BARE_DAY), F.concat(F.trim(day), F.lit(" "), F.trim(label))).otherwise(F.col("date_time"))
    a = articles.select(F.lit("articles").alias("tbl"), F.col("article_id").cast("string").alias("row_key"), F.col("source_label").alias("__key"), F.col("date_time").alias("written"), whole.alias("__text"), F.col("fetched_at").alias("__at"))
    rows = m.unionByName(p).unionByName(a).join(home, F.col("__key") == F.col("__feed"), "left").withColumn("__base", local_day("__at"))
    rows = parse_wall_time(rows, "__text", "__parsed", base_day="__base")
    return resolve_utc(rows, spans, "__parsed", "__home").select("tbl", "row_key", "written", "utc_us", "utc_us_status")


def nonstandard_instants(instants: DataFrame) -> DataFrame:
    """(tbl, row_key, utc_us): distinct instants of rows not written exactly as ``YYYY-MM-DDTHH:MM:SS+00:00``."""
    plain = F.coalesce(F.col("written").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"), F.lit(False))
    return instants.where(F.col("utc_us").isNotNull() & F.col("row_key").isNotNull() & ~plain).select("tbl", "row_key", "utc_us").distinct()
