"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    asked = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in asked.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, asked.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_all_have_sql():
    queries = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert queries == {n for n in entry.oracle_sql() if not n.startswith("op")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
