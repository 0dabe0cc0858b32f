"""Round trips of tables through other formats: what is read must be what was written."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quern.scale import shared_dir
from quern.sources import embedded as E
from quern.sources import files as S
from quern.sources.tables import table


def _place(spark, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    os.makedirs(E.local_path(folder), exist_ok=True)
    return folder


def csv_scan(spark, d):
    """Orders written and read as separated values, types inferred."""
    path = _place(spark, "csv")
    S.write_csv(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return S.nan_to_null(S.read_csv(spark, path, broken_lines=False)).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice")


def tsv_glob_scan(spark, d):
    """Several files of tab-separated values read by one glob, with texts that hold tabs and line breaks."""
    path = _place(spark, "tsv")
    n = table(spark, d, "nation").withColumn("note", F.concat("n_name", F.lit("\t\n"), "n_name"))
    for k in range(3):
        n.where(F.col("n_nationkey") % 3 == k).write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{path}/part{k}")
    got = S.read_csv(spark, f"{path}/part*", "n_nationkey bigint, n_name string, n_regionkey bigint, note string", "\t")
    return got.select("n_nationkey", "n_name", F.length("note").cast("bigint").alias("chars"))


def json_scan(spark, d):
    path = _place(spark, "json")
    table(spark, d, "region").select(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("rows"))["rows"].alias("rows")).coalesce(1).write.mode("overwrite").json(path)
    got = S.read_json(spark, path, "rows array<struct<r_regionkey:bigint,r_name:string>>", True)
    return got.select(F.inline("rows"))


def xml_scan(spark, d):
    path = _place(spark, "xml")
    table(spark, d, "nation", "n_nationkey", "n_name").write.mode("overwrite").option("rowTag", "nation").option("rootTag", "nations").format("xml").save(path)
    return S.read_xml(spark, path, "nation", "n_nationkey bigint, n_name string")


def sqlite_scan(spark, d):
    """Customers inserted in batches, some twice, and read back by ranges of rowids with two columns cast."""
    path = f"{_place(spark, 'sqlite')}/t.db"
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    E.write_sqlite(c, path, "customers", ["c_custkey"])
    E.write_sqlite(c.where("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), path, "customers", ["c_custkey"])
    return E.read_sqlite(spark, path, "customers", "c_custkey bigint, c_acctbal string, c_name string").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def workbook_scan(spark, d):
    """Nations from a workbook of two sheets, found by their header."""
    path = f"{_place(spark, 'book')}/t.xlsx"
    E.write_workbook({"regions": table(spark, d, "region"), "nations": table(spark, d, "nation")}, path)
    return E.read_workbooks(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint")


def array_scan(spark, d):
    """Vectors through NumPy files: rows, their length and the sum of all."""
    folder = _place(spark, "npy")
    E.write_arrays(table(spark, d, "embeddings", "embedding"), folder, "embedding")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return E.read_arrays(spark, f"{folder}/*.npy").groupBy(F.size("values").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(total), 3) + 0.0).alias("total"))


def json_state(spark, d):
    """Progress of channels written in one step and read back."""
    path = f"{_place(spark, 'state')}/progress.json"
    last = table(spark, d, "messages", "channel", "id").groupBy("channel").agg(F.max("id").alias("last"))
    for half in (F.col("last") < 0, F.col("last") >= 0):
        E.write_json_document({"channels": [r.asDict() for r in last.where(half).toLocalIterator()]}, path)
    return S.read_json(spark, path, "channels array<struct<channel:string,last:bigint>>", True).select(F.inline("channels"))


def replaced_partitions(spark, d):
    """Only the statuses that come again are replaced."""
    path = _place(spark, "parts")
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    S.write_partitions(o, path, ["o_orderstatus"])
    S.write_partitions(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(1.0)), path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def discovered_tables(spark, d):
    """Tables found by the columns they need, and columns by the first name they have."""
    tables = {t: table(spark, d, t) for t in ("region", "nation", "supplier")}
    name = S.find_table(tables, ["S_SUPPKEY", "s_name"])
    key = S.first_existing(tables[name], ["id", "S_Suppkey"])
    return S.project_existing(tables[name], [key, "s_missing", "s_name"])


def page_cells(spark, d):
    """A labelled value from pages of three makes: table cells, plain texts, bold label."""
    a = table(spark, d, "articles", "article_id", "title").where("title is not null").distinct()
    k, t = F.col("article_id") % 3, F.regexp_replace("title", "[<>&\"']", "")
    page = (
        F.when(k == 0, F.concat(F.lit("<table><tr><td>Дата</td><td>1</td></tr><tr><td> Организатор </td><td><b>"), t, F.lit("</b> <i>Б  Банк</i></td></tr></table>")))
        .when(k == 1, F.concat(F.lit("<div>Организатор</div><p>"), t, F.lit("</p><p>Б Банк</p><p>Регистратор</p><p>x</p>")))
        .otherwise(F.concat(F.lit("<b>— Организатор </b></td> <td class=x> "), t, F.lit("</td>")))
    )
    return S.html_cells(a.withColumn("h", page), "h", "Организатор", "organiser", ["Регистратор", "Андеррайтер"]).select("article_id", "organiser")


def page_ratings(spark, d):
    """History of ratings and links from a page."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    page = F.concat(F.lit("<div class='b-actions'><table><tr><td>Рейтинг</td><td>Дата</td></tr><tr><td> ru<b>A+</b></td><td>c 01.02.20"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("</td></tr><tr><td>one</td></tr><tr><td>"), F.col("n_name"), F.lit("</td><td>нет</td></tr></table><a class=x href='/r/"), F.col("n_name"), F.lit("'>x</a></div>"))
    r = S.rating_history(S.html_links(n.withColumn("h", page), "h").withColumn("k", F.concat_ws(";", F.col("n_nationkey").cast("string"), F.array_join("links", ","))), "h", "k")
    return r.select("k", F.col("nth").cast("bigint").alias("nth"), "rating", "day")


_NAMES = "csv_scan tsv_glob_scan json_scan xml_scan sqlite_scan workbook_scan array_scan json_state replaced_partitions discovered_tables page_cells page_ratings"
QUERIES = {n: globals()[n] for n in _NAMES.split()}
ORACLE = {
    "csv_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "tsv_glob_scan": "SELECT n_nationkey::BIGINT n_nationkey, n_name, 2 * length(n_name) + 2 AS chars FROM nation",
    "json_scan": "SELECT r_regionkey::BIGINT r_regionkey, r_name FROM region",
    "xml_scan": "SELECT n_nationkey::BIGINT n_nationkey, n_name FROM nation",
    "sqlite_scan": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "workbook_scan": "SELECT n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey FROM nation",
    "array_scan": "SELECT len(embedding)::BIGINT AS size, count(*) n, round(sum(list_sum(embedding::DOUBLE[])), 3) + 0.0 total FROM embeddings GROUP BY 1",
    "json_state": "SELECT channel, max(id) AS last FROM messages GROUP BY 1",
    "replaced_partitions": "SELECT o_orderstatus, count(*) n, round(CASE WHEN o_orderstatus = 'F' THEN count(*) ELSE sum(o_totalprice) END, 2) total FROM orders GROUP BY 1",
    "discovered_tables": "SELECT s_suppkey, s_name FROM supplier",
    "page_cells": """SELECT article_id, CASE WHEN article_id % 3 < 2 THEN t || '; Б Банк' ELSE t END organiser FROM (SELECT DISTINCT article_id, trim(regexp_replace(regexp_replace(title, '[<>&"'']', '', 'g'), '[\\s\\x{A0}]+', ' ', 'g')) t FROM articles WHERE title IS NOT NULL)""",
    "page_ratings": "SELECT n_nationkey || ';/r/' || n_name AS k, i AS nth, CASE i WHEN 1 THEN 'ru A+' ELSE n_name END rating, CASE i WHEN 1 THEN make_date(2000 + n_nationkey, 2, 1) END AS day FROM nation, (VALUES (1::BIGINT), (2::BIGINT)) t(i)",
}
