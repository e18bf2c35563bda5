"""Every query on the smallest data against its SQL in DuckDB."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from wovengraph.plans import catalog
from wovengraph.plans.fixture import BASE_TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v) if isinstance(v, Decimal) else str(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert _canonical(df.columns, got) == _canonical(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["resource", "start_jdn"]
