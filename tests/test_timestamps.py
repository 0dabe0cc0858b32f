from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from quern.operators.timestamps import interval_table, nonstandard_instants, parse_wall_time, publication_instants, resolve_utc, zone_intervals


def us(y, m, d, h=0, mi=0, s=0, f=0, zone="UTC"):
    at = datetime(y, m, d, h, mi, s, f, tzinfo=ZoneInfo(zone))
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


CASES = [
    ("2023-07-07T01:53:31+00:00", us(2023, 7, 7, 1, 53, 31)), ("2018-02-16T04:45:29+07", us(2018, 2, 15, 21, 45, 29)), ("2020-05-05T10:00:00-03:30", us(2020, 5, 5, 13, 30)),
    ("2024-01-02 03:04:05,678", us(2024, 1, 2, 3, 4, 5, 678000, "Europe/Berlin")), ("2024-07-02T03:04", us(2024, 7, 2, 3, 4, zone="Europe/Berlin")), ("2021-03-04T05:06:07.123456Z", us(2021, 3, 4, 5, 6, 7, 123456)),
    ("05.03.21 12:30", us(2021, 3, 5, 12, 30, zone="Europe/Berlin")), ("1515634067", 1515634067 * 10**6), ("1516591383837", 1516591383837 * 1000), ("20180121T183316Z", us(2018, 1, 21, 18, 33, 16)),
    ("24.03.2018 12:19 CET", us(2018, 3, 24, 11, 19)), ("2018-08-21 12:01:55 AM EDT", us(2018, 8, 21, 4, 1, 55)), ("02/16/2018 8:34 PM", us(2018, 2, 16, 20, 34, zone="Europe/Berlin")), ("19.05.2018 15:11:05 (UTC+05:30)", us(2018, 5, 19, 9, 41, 5)),
    ("29 ноября 2025 г. в 07:34 (мск)", us(2025, 11, 29, 4, 34)), ("5 авг 2018 14:31", us(2018, 8, 5, 14, 31, zone="Europe/Berlin")), ("Sat, 06 Jan 2018 03:15:51 +0000", us(2018, 1, 6, 3, 15, 51)), ("2018-03-25 01:30:00 UTC", us(2018, 3, 25, 1, 30)),
    ("2021-10-31 02:30", None), ("2021-03-28 02:30", None), ("31.02.2020 10:00", None), ("29.02.2019 08:15", None), ("2021-13-05T09:00:00", None), ("0000-00-00 00:00:00", None), ("2020-01-01 25:00", None),
    ("2020-01-01 10:00 XYZ", None), ("вчера", None), ("n/a", None), ("", None), (None, None), ("2020-01-01", None), ("x" * 100_000, None), ("13/14/2020 10:00", None), ("14/03/2020 10:00", us(2020, 3, 14, 10, zone="Europe/Berlin")), ("03/04/2020 10:00", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, t, "Europe/Berlin") for i, (t, _) in enumerate(CASES)], "i int, t string, z string")
    out = resolve_utc(parse_wall_time(df, "t", "p"), interval_table(spark, ["Europe/Berlin", "Europe/Moscow"]), "p", "z")
    got = {r["i"]: r["utc_us"] for r in out.collect()}
    assert len(got) == len(CASES)
    assert {CASES[i][0]: v for i, v in got.items() if v != CASES[i][1]} == {}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Novosibirsk", "Europe/Moscow", "Asia/Kolkata"])
def test_intervals_against_zoneinfo(zone):
    spans = {s for _, _, v in zone_intervals([zone], (2009, 2021)) for s in v}
    tz = ZoneInfo(zone)
    for hour in range(0, 24 * 365 * 11, 5):
        local = us(2009, 6, 1) + hour * 3_600_000_000
        naive = datetime(1970, 1, 1).fromtimestamp(local / 1e6, timezone.utc).replace(tzinfo=None)
        both = {int(naive.replace(tzinfo=tz, fold=f).utcoffset().total_seconds()) * 10**6 for f in (0, 1)}
        real = {o for o in both if datetime.fromtimestamp((local - o) / 1e6, timezone.utc).astimezone(tz).replace(tzinfo=None) == naive}
        assert {o for lo, hi, o in spans if lo <= local < hi} == real


def test_publication_instants(spark):
    feeds = spark.createDataFrame([("ch", "telegram", "Asia/Kolkata"), ("smartlab", "forum", "Europe/Moscow"), ("News", "news", "Europe/London")], "feed string, kind string, home_zone string")
    m = spark.createDataFrame([(1, "ch", "2020-01-01 05:30", 1), (1, "ch", "2020-01-01 05:30", 2), (2, "other", "2020-01-01 05:30", 1), (3, None, "2020-01-01T00:00:00+00:00", 1), (4, "ch", None, 1), (5, "ch", "2020-01-01T00:00:00+00:00", 1)], "id long, channel string, date string, __home long")
    p = spark.createDataFrame([("p1", "Вчера в 23:10", "2021-05-02T22:30:00+00:00"), ("p2", "сегодня, 01:00", None), ("p3", None, "2021-05-02T22:30:00+00:00")], "post_id string, published_at string, collected_at string")
    a = spark.createDataFrame(
        [(1, "2020-06-01", None, "9:05 PM", "News", None), (2, None, "3 июня 2020", "12.30", "News", None), (3, "2020-06-01 10:00 UTC", "2.6.2020", "11:00", None, None), (4, "2020-06-01", None, None, "News", None), (5, None, None, "10:00", "News", None), (6, "2020-06-01", None, "12:00 (UTC+02)", None, None), (7, "n/a", "2020-06-01", "10:00", "News", None)],
        "article_id long, date_time string, date_label string, time_label string, source_label string, fetched_at string",
    )
    rows = publication_instants(m, p, a, feeds)
    assert rows.count() == 16
    got = {(r["tbl"], r["row_key"]): r["utc_us"] for r in nonstandard_instants(rows).collect()}
    assert got == {("messages", "ch:1"): us(2020, 1, 1), ("posts", "p1"): us(2021, 5, 2, 20, 10), ("articles", "1"): us(2020, 6, 1, 20, 5), ("articles", "2"): us(2020, 6, 3, 11, 30), ("articles", "3"): us(2020, 6, 1, 10), ("articles", "6"): us(2020, 6, 1, 10)}
    empty = nonstandard_instants(publication_instants(m.limit(0), p.limit(0), a.limit(0), feeds.limit(0)))
    assert empty.count() == 0 and empty.columns == ["tbl", "row_key", "utc_us"]
