"""Every query of the library against its SQL on the smallest test data."""

import decimal

import duckdb
import pytest

from chronofold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, oracle, name):
    got = catalog.queries()[name](spark, sf)
    want = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(repr([plain(r[n]) for n in names]) for r in got.collect())
    assert rows == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
