"""SQLite, workbooks, NumPy files, documents written in one step, and values of pages."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import embedded as E
from quern.sources import files as S


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    df = spark.createDataFrame([(i, f"имя {i}" if i % 3 else None, i / 4) for i in range(23)], "id long, name string, x double")
    assert E.write_sqlite(df, path, "t", ["id"], rows=5) == 23
    more = spark.createDataFrame([(1, "new", 0.0), (99, "late", None)], "id long, name string, x double")
    E.write_sqlite(more, path, "t", ["id"])
    got = E.read_sqlite(spark, path, "t", "x string, id long", 4)
    assert got.rdd.getNumPartitions() > 5 and got.count() == 24
    assert {r["id"]: r["x"] for r in got.collect()}[1] == "0.25"
    E.write_sqlite(more, path, "t", ["id"], ignore=False)
    assert {r["id"]: r["name"] for r in E.read_sqlite(spark, path, "t", "id long, name string").collect()}[1] == "new"
    E.write_sqlite(df.limit(0), path, "empty")
    assert E.read_sqlite(spark, path, "empty", "id long, name string").count() == 0


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    a = spark.createDataFrame([(1, "a <&> \"b\"", 1.5, datetime.datetime(2024, 5, 1, 12)), (None, None, None, None), (3, "ё\nx", -2.0, None)], "i int, s string, x double, t timestamp")
    many = spark.range(40).select(*[(F.col("id") + k).alias(f"c{k}") for k in range(30)])
    E.write_workbook({"one": many, "two": a}, path)
    rows = {tuple(r) for r in E.read_workbooks(spark, path, "i int, s string, x double, t timestamp_ntz").collect()}
    assert rows == {(1, 'a <&> "b"', 1.5, datetime.datetime(2024, 5, 1, 12)), (3, "ё\nx", -2.0, None)}
    assert {r[0] - r["id"] for r in E.read_workbooks(spark, path, "c29 long, c0 long").withColumnRenamed("c0", "id").collect()} == {29}
    assert E.read_workbooks(spark, path, "i int", "one").where("i is not null").count() == 0
    with pytest.raises(ValueError, match="rows"):
        E.SHEET_ROWS, kept = 10, E.SHEET_ROWS
        try:
            E.write_workbook({"one": many}, path)
        finally:
            E.SHEET_ROWS = kept


def test_arrays_and_documents(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.array([7, 8]))
    got = E.read_arrays(spark, str(tmp_path / "*.npy")).collect()
    assert sorted(r["values"] for r in got) == sorted([*x.tolist(), [7.0, 8.0]])
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0, 4.0],)], "v array<double>")
    (tmp_path / "out").mkdir()
    assert E.write_arrays(df, f"file://{tmp_path}/out", "v") == 2
    assert sorted(r["values"] for r in E.read_arrays(spark, str(tmp_path / "out/*.npy")).collect()) == [[1.0, 2.0], [3.0, 4.0]]
    for v in ({"a": 1}, {"b": "ё"}):
        E.write_json_document(v, f"file://{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"b": "ё"} and len(list(tmp_path.glob("d.json*"))) == 1


def test_page_values(spark):
    pages = {
        "cells": "<table><tr><td><b>Организатор</b></td><td>А Банк<br>Б&nbsp;Банк</td><td>А Банк</td></tr></table>",
        "stream": '<p>Организатор</p><i>"А Банк"</i><p>Б Банк</p><p>А Банк</p><h1>Регистратор</h1><p>x</p>',
        "bold": "<b>Прочее: Организатор </b></th><td class='c'>&quot;А Банк&quot;</td>",
        "none": "<p>пусто</p>",
    }
    df = spark.createDataFrame([*pages.items(), ("null", None)], "k string, h string")
    got = {r["k"]: r["o"] for r in S.html_cells(df, "h", "Организатор", "o", ["Регистратор"]).collect()}
    assert got["cells"] == "А Банк; Б Банк" and got["stream"] == "А Банк; Б Банк" and got["none"] is None and got["null"] is None
    page = "<table><tr><td>Рейтинг</td><td>Дата</td></tr><tr><td>ruA</td><td>от 05.03.2021 г.</td></tr><tr><td></td><td>1</td></tr><tr><td>ruB</td><td>нет</td></tr></table>"
    r = S.rating_history(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "h", "k").collect()
    assert [(x["rating"], x["day"]) for x in r] == [("ruA", datetime.date(2021, 3, 5)), ("ruB", None)]
