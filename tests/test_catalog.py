"""Every query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from conftest import SF
from docweave.plans import catalog


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    want = _rows(columns, cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want


def test_tokens_roundtrip_goes_through_python_once(spark):
    plan = catalog.queries()["json_tokens_roundtrip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 2  # tokens, and texts of tokens
