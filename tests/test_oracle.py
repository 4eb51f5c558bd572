"""Every query of the pricing engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from tarnwick.plans.oracle import ORACLE
from tarnwick.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if value != value else round(float(value), 9) + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()[:10]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
