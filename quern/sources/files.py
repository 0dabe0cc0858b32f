"""Readers and writers of files beside parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", broken_lines: bool = True) -> DataFrame:
    """Files of separated values with a header, by glob. Without a schema types are inferred in a pass of their own.

    Line breaks in quotes are kept, for which a file is read by one task; without ``broken_lines`` large files are split between tasks.
    """
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", broken_lines).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, documents: bool = False) -> DataFrame:
    """JSON lines, or one document a file."""
    return spark.read.schema(schema).option("multiLine", documents).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns as null, which aggregates skip."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that is a column, letter case aside."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def project_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def find_table(tables: dict[str, DataFrame], needed: list[str]) -> str | None:
    """The first table that has all the needed columns."""
    return next((k for k, df in tables.items() if {n.lower() for n in needed} <= {c.lower() for c in df.columns}), None)


def write_csv(df: DataFrame, path: str) -> None:
    """Separated values with header; texts are written in UTF-8, times without zone."""
    flat = df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def html_cells(df: DataFrame, html: str, label: str, out: str, ends: list[str] | None = None) -> DataFrame:
    """The value of ``label`` in a page, its distinct parts joined by '; ', or null.

    First the cell behind the one that holds the label alone (with ``ends`` the texts of all cells behind it); else the texts behind the label up to
    one of ``ends`` (without: the next text); else what follows the label in bold in the next cell, or on its line.
    """
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"&nbsp;|\u00a0", " "), r"\s+", " "))
    pieces = lambda c: F.filter(F.transform(F.split(c, r"(?s)<[^>]*>"), lambda x: F.regexp_replace(text(x), r'^"+|"+$', "")), lambda x: x != "")
    joined = lambda c: F.nullif(F.array_join(F.array_distinct(c), "; "), F.lit(""))
    row = F.regexp_extract(html, rf"(?is)<t[dh][^>]*>\s*(?:<[^>]+>\s*)*{label}\s*:?\s*(?:</[^>]+>\s*)*</t[dh]>(.*?)</tr>", 1)
    cell = F.nullif(text(F.regexp_replace(F.regexp_extract(row, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", 1), r"(?s)<[^>]+>", " ")), F.lit(""))
    stream = pieces(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "))
    at = F.array_position(stream, label)
    behind = F.slice(stream, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(stream), F.lit(1)))
    stop = F.array_min(F.array(*[F.when(F.array_position(behind, e) > 0, F.array_position(behind, e)).otherwise(F.lit(1 << 30)) for e in ends])) if ends else F.lit(2)
    listed = F.when(at > 0, F.slice(behind, F.lit(1), (F.least(stop, F.size(behind) + 1) - 1).cast("int")))
    bold = F.regexp_extract(html, rf"(?is){label}\s*</b>.*?<td[^>]*>\s*(?:&quot;|\"|')?([^<\"']+)", 1)
    line = F.regexp_extract(F.regexp_replace(html, r"(?s)<[^>]+>", "\n"), rf"(?i){label}\s*:?\s*([^\n]+)", 1)
    return df.withColumn(out, F.coalesce(joined(pieces(row)) if ends else cell, joined(listed), F.nullif(text(bold), F.lit("")), F.nullif(text(line), F.lit(""))))


def rating_history(df: DataFrame, html: str, key: str, headers: tuple[str, ...] = ("национальная", "шкала", "рейтинг", "дата")) -> DataFrame:
    """(key, nth, rating, day, written): rows of two cells and more of the tables of a page, the second holding a date; rows with a word of ``headers`` are none."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"(?s)(?:<[^>]+>|\s)+", " ")))
    out = df.select(F.col(key), F.posexplode(F.filter(F.transform(rows, cells), lambda c: F.size(c) >= 2)).alias("nth", "c"))
    rating, written = F.col("c")[0], F.col("c")[1]
    day = F.try_to_date(F.regexp_extract(written, r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy")
    return out.where((rating != "") & ~F.lower(rating).rlike("|".join(headers))).select(key, "nth", rating.alias("rating"), day.alias("day"), written.alias("written"))


def html_links(df: DataFrame, html: str, out: str = "links") -> DataFrame:
    return df.withColumn(out, F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)"""), F.lit(1)))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]
