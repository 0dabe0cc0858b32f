"""Interval, as-of, fallback, inheritance and substring joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scale import checked_broadcast


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bounds: str = "()", bucket_seconds: int | None = None, how: str = "inner") -> DataFrame:
    """Points with the spans of the same key that hold them; ``bounds`` is one of ``()``, ``[)``, ``[]``, ``(]``.

    With ``bucket_seconds`` spans are exploded into time buckets and the join is on (key, bucket), so that a hot
    key is spread over its buckets; without, it is on the key with the range as residual. ``how`` is inner or left (all spans kept:
    the left side is then ``spans``). Null keys, times and ends match nothing.
    """
    t, a, b = F.col(at), F.col(start), F.col(end)
    inside = ((t > a) if bounds[0] == "(" else (t >= a)) & ((t < b) if bounds[1] == ")" else (t <= b))
    points = points.withColumnRenamed(key, "__key")
    if bucket_seconds:
        number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
        points = points.withColumn("__bucket", number(t))
        cover = F.when(a <= b, F.sequence(number(a), number(b)))
        cut = spans.withColumn("__b", F.explode_outer(cover))
        matched = points.join(cut, (F.col("__key") == F.col(key)) & (F.col("__bucket") == F.col("__b")) & inside).drop("__bucket", "__b", "__key")
        if how == "inner":
            return matched
        extra = [c for c in matched.columns if c not in spans.columns]
        missing = spans.join(matched.select(*spans.columns).distinct(), spans.columns, "left_anti")
        return matched.unionByName(missing.select("*", *[F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in extra]))
    on = (F.col("__key") == F.col(key)) & inside
    joined = spans.join(points, on, "left") if how == "left" else points.join(spans, on)
    return joined.drop("__key")


def asof_join(targets: DataFrame, history: DataFrame, key: str, at: str, history_at: str, values: list[str], fallback: bool = False, order: str | None = None, bucket_days: int = 64) -> DataFrame:
    """Each target with the last history row of its key at or before it, and ``asof_side``: before, after or null.

    With ``fallback`` a target before all history takes the earliest row (side ``after``). Of rows at one time the one last by
    ``order`` wins, in the fallback the first. Rows are sorted within (key, time bucket); a small table carries the value from bucket to bucket,
    so neither a hot key nor a long history is ordered by one task. Targets with null key or time get nulls; every target gives one row.
    """
    seq = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    bucket = F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / F.lit(bucket_days * 86_400_000_000))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    h = history.where(F.col(key).isNotNull() & F.col(history_at).isNotNull()).select(F.col(key).alias("__k"), F.col(history_at).alias("__t"), seq.alias("__o"), F.struct(F.col(history_at), *values).alias("__v"))
    h = h.withColumn("__b", bucket)
    t = targets.where(known).select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.struct("*").alias("__row")).withColumn("__b", bucket)
    sums = h.groupBy("__k", "__b").agg(F.max_by("__v", F.struct("__t", "__o")).alias("__lv"), F.min_by("__v", F.struct("__t", "__o")).alias("__fv"))
    grid = sums.unionByName(t.select("__k", "__b").distinct().join(sums, ["__k", "__b"], "left_anti"), allowMissingColumns=True)
    # frames that grow from the start cost one step a row; one that runs to the end would be read anew for each row
    up, down = Window.partitionBy("__k").orderBy("__b"), Window.partitionBy("__k").orderBy(F.desc("__b"))
    grid = grid.select("__k", "__b", F.last("__lv", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("__prev"), F.last("__fv", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    both = h.withColumn("__side", F.lit(0)).unionByName(t.withColumn("__side", F.lit(1)).withColumn("__o", F.lit(0).cast("bigint")), allowMissingColumns=True)
    w = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__o")
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if fallback:
        back = Window.partitionBy("__k", "__b").orderBy(F.desc("__t"), F.desc("__side"), F.desc("__o"))
        both = both.withColumn("__next", F.last("__v", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = both.where("__side = 1").join(grid, ["__k", "__b"], "left")
    before = F.coalesce("__last", "__prev")
    after = F.coalesce("__next", "__later") if fallback else F.lit(None).cast(both.schema["__v"].dataType)
    side = F.when(before.isNotNull(), "before").when(after.isNotNull(), "after")
    out = rows.select("__row", F.coalesce(before, after).alias("__p"), side.alias("asof_side"))
    out = out.select("__row.*", F.col(f"__p.{history_at}").alias(f"asof_{history_at}"), *[F.col(f"__p.{v}").alias(v) for v in values], "asof_side")
    return out.unionByName(targets.where(~known), allowMissingColumns=True)


def next_in_calendar(events: DataFrame, calendar: DataFrame, at: str, day: str) -> DataFrame:
    """Each event with the first calendar day at or after it, ``next_day``; null past the end, and for a null time. The calendar is a column of distinct days.

    A calendar is a row a day: the days from one entry to the next are written out with the one they lead to, and events are equi-joined with them by
    their date (a moment after midnight by the date after), so events of a day need not meet in one task. Events before the calendar have its first day.
    """
    days = calendar.select(F.to_date(day).alias("__d")).where("__d is not null").distinct()
    steps = days.withColumn("__from", F.date_add(F.lag("__d").over(Window.orderBy("__d")), 1))  # a row a day of the calendar
    steps = steps.select(F.col("__d").alias("next_day"), F.explode(F.sequence(F.coalesce("__from", "__d"), F.col("__d"))).alias("__day"))
    first = days.agg(F.min("__d").alias("__first"))
    t = F.col(at)
    date = F.to_date(t)
    rows = events.crossJoin(F.broadcast(first)).withColumn("__asked", F.greatest(F.when(t > date.cast(events.schema[at].dataType), F.date_add(date, 1)).otherwise(date), F.when(t.isNotNull(), F.col("__first"))))
    return rows.join(checked_broadcast(steps), F.col("__asked") == F.col("__day"), "left").select(*events.columns, "next_day")


def fallback_lookup(rows: DataFrame, sources: list[tuple[DataFrame, list[str]]], value: str, out: str) -> DataFrame:
    """Left lookups tried in order; ``out`` is the first non-null ``value`` and ``out + '_from'`` the place (1, 2, …) it came from.

    Each source is made unique by its keys first (least value), so no row is repeated.
    """
    got, place = [], F.lit(None).cast("int")
    for i, (src, keys) in enumerate(sources, 1):
        one = src.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(f"__v{i}"))
        rows = rows.join(one, keys, "left")
        got.append(F.col(f"__v{i}"))
    for i in range(len(got), 0, -1):
        place = F.when(got[i - 1].isNotNull(), i).otherwise(place)
    return rows.withColumn(out, F.coalesce(*got)).withColumn(f"{out}_from", place).drop(*[f"__v{i}" for i in range(1, len(got) + 1)])


def inherit_from_parent(replies: DataFrame, matched: DataFrame, key: str, parent: str, at: str, short: str, most_hours: float = 72.0) -> DataFrame:
    """Matches a reply without own ones takes over from its parent: (reply's key, parent's key as ``anchor``, columns of the match).

    ``matched`` has own matches (``key``, ``at``, ``level``, …). An unknown gap in time counts as near; short replies only inherit if
    the parent has a match of level 'offering'. Depth one: inherited matches are not passed on.
    """
    own = matched.select(F.col(key).alias("__own")).distinct()
    level = matched.groupBy(F.col(key).alias("__lk")).agg(F.max((F.col("level") == "offering").cast("int")).alias("__offering"))
    open_ = replies.where(F.col(parent).isNotNull()).join(own, F.col(key) == F.col("__own"), "left_anti")
    m = matched.select(F.col(key).alias("anchor"), F.col(at).alias("__pat"), *[c for c in matched.columns if c not in (key, at)])
    pairs = open_.select(F.col(key), F.col(parent).alias("__p"), F.col(at).alias("__at"), F.col(short).alias("__short")).join(m, F.col("__p") == F.col("anchor"))
    pairs = pairs.join(level, F.col("anchor") == F.col("__lk"))
    gap = F.abs(F.unix_micros(F.col("__at").cast("timestamp")) - F.unix_micros(F.col("__pat").cast("timestamp"))) / F.lit(3_600_000_000.0)
    near = gap.isNull() | (gap <= most_hours)
    return pairs.where(near & (~F.col("__short") | (F.col("__offering") == 1))).drop("__p", "__at", "__short", "__pat", "__lk", "__offering")


def semi_or_unlinked(rows: DataFrame, links: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Rows without any link, or with at least one ``wanted`` link."""
    state = links.groupBy(key).agg(F.max(F.coalesce(wanted, F.lit(False)).cast("int")).alias("__any"))
    return rows.join(state, key, "left").where("__any is null or __any = 1").drop("__any")


def best_match(queries: DataFrame, items: DataFrame, query: str, item: str, prefix: int = 3) -> DataFrame:
    """For each query the item equal to it, else the least one that starts with it, else the least one that it starts with.

    Candidates come by an equi-join on beginnings: both sides bring theirs of every length up to ``prefix``, and of a pair the
    shorter text (its length up to ``prefix``) says by which it meets. Null and empty texts match nothing.
    """
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(prefix))), lambda n: F.substring(c, F.lit(1), n))
    q = queries.withColumn("__q", F.lower(F.trim(query)))
    i = items.select(F.col(item).alias("match"), F.lower(F.trim(item)).alias("__i")).where("__i <> ''").distinct()
    pairs = q.where("__q <> ''").withColumn("__pre", F.explode(starts(F.col("__q")))).join(i.withColumn("__pre", F.explode(starts(F.col("__i")))), "__pre")
    pairs = pairs.where(F.length("__pre") == F.least(F.length("__q"), F.length("__i"), F.lit(prefix)))
    rank = F.when(F.col("__i") == F.col("__q"), 0).when(F.startswith("__i", "__q"), 1).when(F.startswith("__q", "__i"), 2)
    best = pairs.where(rank.isNotNull()).groupBy(F.col("__q").alias("__bq")).agg(F.min(F.struct(rank.alias("rank"), F.col("match"))).alias("__b"))
    out = q.join(best, F.col("__q") == F.col("__bq"), "left")
    return out.select(*queries.columns, F.col("__b.match").alias("match"), F.col("__b.rank").alias("match_rank"))


def substring_match(left: DataFrame, right: DataFrame, a: str, b: str, gram: int = 3) -> DataFrame:
    """Pairs of distinct texts of which one contains the other, letter case aside, also within words.

    A text contained shares all its runs of ``gram`` letters with the other, so of each pair the one that is contained brings its rarest run (or all of itself,
    if it is shorter) and the other brings all of its runs of that length to an equi-join. Null and empty texts match nothing.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - F.lit(n - 1)), lambda i: F.substring(c, i, F.lit(n))))

    def grams(df, key, low):
        out = [F.when(F.length(low) >= n, runs(F.col(low), n)).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1)]
        return df.select(key, F.explode(F.flatten(F.array(*out))).alias("g"))

    l = left.select(F.col(a).alias("__a"), F.lower(a).alias("__low")).where("__a <> ''").distinct()
    r = right.select(F.col(b).alias("__b"), F.lower(b).alias("__low")).where("__b <> ''").distinct()
    of_l, of_r = grams(l, "__a", "__low"), grams(r, "__b", "__low")
    every = of_l.select("g").unionByName(of_r.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df, key):
        longest = df.where(F.length("g") == F.least(F.length(key), F.lit(gram)))
        return longest.join(every, "g").groupBy(key).agg(F.min_by("g", F.struct("n", "g")).alias("g"))

    inside = rarest(of_l, "__a").join(of_r, "g").where(F.contains(F.lower("__b"), F.lower("__a")))
    around = rarest(of_r, "__b").join(of_l, "g").where(F.contains(F.lower("__a"), F.lower("__b")))
    return inside.select(F.col("__a").alias(a), F.col("__b").alias(b)).unionByName(around.select(F.col("__a").alias(a), F.col("__b").alias(b))).distinct()


def inherit_scored(replies: DataFrame, resolved: DataFrame, key: str, parent: str, at: str, short: str, score: str, decay: float = 0.7, short_penalty: float = 0.5, most_hours: float = 72.0) -> DataFrame:
    """:func:`inherit_from_parent` with the parent's ``score`` times ``decay``, and times ``short_penalty`` for short replies, rounded to 4 digits."""
    got = inherit_from_parent(replies, resolved, key, parent, at, short, most_hours)
    factor = F.when(F.col("__s"), decay * short_penalty).otherwise(decay)
    return got.join(replies.select(F.col(key), F.col(short).alias("__s")), key).withColumn(score, F.round(F.col(score) * factor, 4)).drop("__s")


def ranked_winner(hits: DataFrame, key: str, score: str, margin: float = 0.12) -> DataFrame:
    """The best hit of each key if it is the only one or leads the second by ``margin``; the other columns are those of the hit, ``lead`` is null for a single one."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *[c for c in hits.columns if c not in (key, score)])
    out = hits.withColumn("__n", F.row_number().over(w)).withColumn("lead", F.col(score) - F.lead(score).over(w)).where("__n = 1")
    return out.where(F.col("lead").isNull() | (F.col("lead") >= margin)).drop("__n")
