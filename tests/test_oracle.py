"""Core queries against their SQL on the smallest data, where it is present."""

import datetime
import glob
import os

import numpy as np
import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_, str)):
        return str(v)
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    return repr(float(v))


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def core():
    import __spark_entry__ as entry
    import importlib

    mods = [importlib.import_module(m) for m in entry.CORE]
    return {k: v for m in mods for k, v in m.QUERIES.items()}, {k: v for m in mods for k, v in m.ORACLE.items()}


def test_core_queries(spark):
    db = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    queries, oracle = core()
    assert set(oracle) <= set(queries)
    wrong = []
    for name, query in queries.items():
        got = query(spark, FOLDER).toPandas()
        if name in oracle:
            want = db.sql(oracle[name]).df()
            if sorted(got.columns) != sorted(want.columns) or rows(got) != rows(want):
                wrong.append(name)
    assert wrong == []
