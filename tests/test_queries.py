"""Every query of the engine against its SQL in DuckDB, and the driver contract."""

import os

import duckdb
import pytest

from tallyframe.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def comparable(rows, columns):
    """Rows with columns by name, numbers to 6 places, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert comparable(got.collect(), got.columns) == comparable(found.fetchall(), columns)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
