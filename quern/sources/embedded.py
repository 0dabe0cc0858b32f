"""SQLite tables, workbooks and NumPy arrays as Spark sources and sinks, and small documents written in one step."""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import sqlite3
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a SQLite partition or batch, and the most rows a sheet may have.
CHUNK_ROWS, SHEET_ROWS = 5000, 1_048_576

_SQLITE = {"string": "TEXT", "binary": "BLOB", "double": "REAL", "float": "REAL"}


def local_path(path: str) -> str:
    """A path of the shared file system as Python opens it."""
    return re.sub("^file:/*", "/", path)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    """Ranges of rowids, read side by side; only the columns of the schema are selected, each cast to its type."""

    def __init__(self, schema, options):
        self.schema, self.path, self.table, self.rows = schema, local_path(options["path"]), options["table"], int(options.get("rows", CHUNK_ROWS))

    def partitions(self):
        with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)] if low is not None else [_Range(0, 0)]

    def read(self, part):
        kinds = {f.name: f.dataType.typeName() for f in self.schema}
        columns = ", ".join(f'CAST("{n}" AS {_SQLITE.get(k, "INTEGER")})' for n, k in kinds.items())
        with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (part.low, part.high))


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite").option("path", …).option("table", …).schema(…)``; option ``rows``: rowids of a partition."""

    @classmethod
    def name(cls):
        return "sqlite"

    def reader(self, schema):
        return SQLiteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns of a SQLite table, in chunks of ``rows`` rowids as partitions in their order; the file must lie where all executors see it."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("rows", rows).schema(schema).load()


def write_sqlite(df: DataFrame, path: str, table: str, key: list[str] | None = None, ignore: bool = True, rows: int = CHUNK_ROWS) -> int:
    """Insert the rows in batches of ``rows``, one transaction each; rows of a known ``key`` are left out (or, without ``ignore``, replaced). Returns the rows sent.

    A SQLite file has one writer: partitions come to the driver one after the other, never all at once.
    """
    columns = ", ".join(f'"{f.name}" {_SQLITE.get(f.dataType.typeName(), "INTEGER")}' for f in df.schema)
    keyed = ", PRIMARY KEY (" + ", ".join(f'"{k}"' for k in key) + ")" if key else ""
    verb = f"INSERT OR {'IGNORE' if ignore else 'REPLACE'}" if key else "INSERT"
    n, batch = 0, []
    with contextlib.closing(sqlite3.connect(local_path(path))) as db:
        db.execute("PRAGMA journal_mode = WAL")
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns}{keyed})')

        def send():
            with db:
                db.executemany(f'{verb} INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', batch)
            batch.clear()

        for r in df.toLocalIterator():
            batch.append(tuple(r))
            n += 1
            if len(batch) == rows:
                send()
        send()
        db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    return n


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets_of(content: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name -> rows of cells as text, of a workbook (xlsx)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            rows: list[list[str | None]] = []
            for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
                while len(rows) < int(r.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list[str | None] = []
                for c in r.findall("m:c", _NS):
                    at = _column(re.match("[A-Z]+", c.get("r", "")) or None, len(cells))
                    cells += [None] * (at - len(cells))
                    v = c.find("m:v", _NS)
                    inline = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else None
                    cells.append(inline if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text)
                rows.append(cells)
            out[s.get("name")] = rows
        return out


def _column(letters, default: int) -> int:
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbooks(spark: SparkSession, path: str, schema: str, sheet: str | None = None) -> DataFrame:
    """Rows of workbooks by glob, a file a task: of the named ``sheet``, else of the first whose header has all columns of the schema. Cells that are no value of their type are null."""
    fields = spark.createDataFrame([], schema).schema
    names = fields.names

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for content in b.column("content").to_pylist():
                for name, cells in sheets_of(content).items():
                    head = cells[0] if cells else []
                    if (name == sheet if sheet else set(names) <= set(head)):
                        at = [head.index(n) if n in head else None for n in names]
                        data = [[r[i] if i is not None and i < len(r) else None for i in at] for r in cells[1:] if any(c is not None for c in r)]
                        yield pa.record_batch([pa.array(c, pa.string()) for c in list(zip(*data)) or [[]] * len(names)], names=names)
                        break

    text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook of several sheets with a bold, frozen header; times lose their zone. A sheet over the format's row limit is an error, none is cut."""
    column = lambda i: (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    part = lambda kind, n: f'<Override PartName="{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>'
    main, rel = f'xmlns="{_NS["m"]}"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    target = local_path(path)
    draft = f"{target}.{uuid.uuid4().hex}"
    with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, df) in enumerate(sheets.items(), 1):
            flat = df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {main}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())

                def write(n, row, style=""):
                    cells = []
                    for i, v in enumerate(row):
                        at = f'r="{column(i)}{n}"{style}'
                        if isinstance(v, (int, float)) and not isinstance(v, bool):
                            cells.append(f"<c {at}><v>{v!r}</v></c>")
                        elif v is not None:
                            cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                    out.write(f'<row r="{n}">{"".join(cells)}</row>'.encode())

                write(1, flat.columns, ' s="1"')
                for n, row in enumerate(flat.toLocalIterator(), 2):
                    if n > SHEET_ROWS:
                        raise ValueError(f"over {SHEET_ROWS} rows in sheet {name}")
                    write(n, row)
                out.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="w" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = part("sheet.main", "/xl/workbook.xml") + part("styles", "/xl/styles.xml") + "".join(part("worksheet", f"/xl/worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
    os.replace(draft, target)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values): the rows of NumPy files (.npy) by glob as arrays of doubles, a file a task."""

    def rows(batches):
        import numpy as np

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                yield pa.record_batch([pa.array([name] * len(x)), pa.array(range(len(x)), pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["path", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row bigint, values array<double>")


def write_arrays(df: DataFrame, folder: str, column: str) -> int:
    """The arrays of a column as NumPy files, one each task and batch, in a folder all executors share. Returns the rows written; nulls are left out."""
    target = local_path(folder)

    def write(batches):
        import numpy as np

        for b in batches:
            x = [v for v in b.column(0).to_pylist() if v is not None]
            if x:
                np.save(f"{target}/{uuid.uuid4().hex}.npy", np.array(x, float))
            yield pa.record_batch({"n": pa.array([len(x)], pa.int64())})

    return df.select(column).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json_document(value: object, path: str) -> None:
    """A small document as JSON, in one step: readers see the old or the new one, never a part."""
    target = local_path(path)
    draft = f"{target}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, target)
