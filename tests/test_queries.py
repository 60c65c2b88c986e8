"""Every core query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from millrace import catalogue
from millrace.catalogue_sql import SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if math.isfinite(v) and v == int(v) else round(v, 8)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    said = duck.sql(SQL[name])
    assert sorted(said.columns) == cols
    got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    want = sorted(str(tuple(plain(dict(zip(said.columns, r))[c]) for c in cols)) for r in said.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, DATA).columns


def test_plans_prune_and_push(spark):
    plan = catalogue.chars_by_source(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)]" in plan and "trained_spans" not in plan
