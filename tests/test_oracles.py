"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from lexigrid import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
