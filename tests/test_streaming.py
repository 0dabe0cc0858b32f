from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators.upsert import upsert_coalesce
from quern.sources.files import first_existing, html_cells, nan_to_null, read_csv, write_csv
from quern.streaming.ingest import distinct_events, read_folder, run_available, upsert_sink, window_counts

T0 = datetime(2024, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 40, T0 + timedelta(minutes=i % 40), i % 3, float(i % 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k int, v double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = distinct_events(read_folder(spark, str(tmp_path / "in"), df.schema), ["id"], "ts", "1 day")
    run_available(s, str(tmp_path / "c1"), name="d")
    assert spark.table("d").count() == 40
    w = window_counts(read_folder(spark, str(tmp_path / "in"), df.schema), "ts", "10 minutes", [], "v", "1 hour")
    run_available(w, str(tmp_path / "c2"), name="w", mode="complete")
    want = {(r["s"], r["n"]) for r in df.groupBy(F.window("ts", "10 minutes").alias("w")).count().select(F.col("w.start").alias("s"), F.col("count").alias("n")).collect()}
    assert {(r["start"], r["n"]) for r in spark.table("w").collect()} == want


def test_upsert_sink(spark, tmp_path):
    write = upsert_sink(str(tmp_path / "t"), ["id"], upsert_coalesce)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    two = spark.createDataFrame([(2, None), (3, "c")], "id int, s string")
    write(one, 0)
    for _ in range(2):
        write(two, 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v=1")).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, "ё")], "i int, s string")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), "i int, s string").collect())) == [(1, 'a,"b"\nc'), (2, "ё")]
    assert first_existing(df, ["x", "S"]) == "s" and first_existing(df, ["x"]) is None
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first()[0] is None
    h = spark.createDataFrame([("<tr><td>Organiser:</td><td>Bank <b>A</b></td></tr>",), ("<p>Organiser: Bank B</p>",), ("<p>none</p>",)], "h string")
    assert [r["o"] for r in html_cells(h, "h", "Organiser", "o").collect()] == ["Bank A", "Bank B", None]
