"""Every registered query runs on the smallest tables and equals its SQL where it has one."""

from __future__ import annotations

import os

import pytest

from tidemark.plans import library

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*order).collect())))
    if name in library.ORACLES:
        rel = duck.sql(library.ORACLES[name])
        assert order == sorted(rel.columns)
        columns = ", ".join(f'"{c}"' for c in order)
        assert got == sorted(map(repr, rel.select(columns).fetchall()))


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
