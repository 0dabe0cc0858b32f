"""Queries on small tables of their own, where the SQL does not tell the whole job."""

import importlib


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_inheritance_within_72_hours(spark, tmp_path):
    R = importlib.import_module("quern.plans.relational")
    text = "вполне длинный ответ про другое"
    dates = {1: "2024-01-10T00:00:00+00:00", 2: "13.01.2024 00:00", 3: "2024-01-13T00:00:01+00:00", 4: None, 5: "2024-01-06T23:59:59+00:00", 6: "2024-01-13T02:00:00+03:00"}
    d = write(
        spark, tmp_path,
        messages=([(i, "c", text, x, 1 if i > 1 else None) for i, x in dates.items()] + [(7, "c", text, dates[1], 4)], "id bigint, channel string, text string, date string, parent_id bigint"),
        telegram_matches=([(f"c:{i}", "A", "issuer", "explicit") for i in (1, 4)], "source_key string, issuer string, entity_level string, match_origin string"),
        feeds=([("c", "telegram", "UTC")], "feed string, kind string, home_zone string"),
        posts=([], "post_id string, published_at string, collected_at string"),
        articles=([], "article_id bigint, date_time string, date_label string, time_label string, source_label string, fetched_at string"),
    )
    assert {(r["k"], r["anchor"]) for r in R.thread_inheritance_timed(spark, d).collect()} == {("c:2", "c:1"), ("c:6", "c:1"), ("c:7", "c:4")}
    assert {r["k"] for r in R.thread_inheritance(spark, d).collect()} == {"c:2", "c:3", "c:5", "c:6", "c:7"}


def test_sequences_of_whole_texts(spark, tmp_path):
    Q = importlib.import_module("quern.plans.textual")
    long = [f"w{i}" for i in range(300)]
    d = write(spark, tmp_path, eval_items=([(1, " ".join(long)), (2, "w0 w0 w1"), (3, None), (4, "")], "item_id bigint, text string"))
    got = {r["item_id"]: r["seq"].split(",") for r in Q.index_sequences(spark, d).collect()}
    assert {len(v) for v in got.values()} == {300}
    assert "1" not in got[1] and len(set(got[1])) == 300 and got[2][:4] == ["2", "2", "3", "0"] and set(got[3] + got[4]) == {"0"}


def test_sequences_of_a_given_length_and_none(spark):
    from quern.operators import vectors as X

    df = spark.createDataFrame([(1, "b a b c"), (2, "b")], "k int, t string")
    vocab = X.vocabulary(df, "t", 1)
    assert {r["k"]: r["seq"] for r in X.index_sequences(df, "k", "t", vocab, 3).collect()} == {1: [2, 1, 2], 2: [2, 0, 0]}
    assert X.index_sequences(df.limit(0), "k", "t", vocab).count() == 0


def test_mined_aliases_of_three_words(spark, tmp_path):
    Q = importlib.import_module("quern.plans.textual")
    rows = [("a", f"белый медведь арктики строка{i}") for i in range(5)] + [("b", f"иной текст {i}") for i in range(5)]
    d = write(spark, tmp_path, documents=(rows, "source string, text string"))
    grams = {r["gram"] for r in Q.alias_mining(spark, d).collect() if r["source"] == "a"}
    assert {"медведь", "белый медведь", "белый медведь арктики"} <= grams
