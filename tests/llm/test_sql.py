"""Queries of the corpus operators against their SQL in DuckDB."""

import os

import duckdb
import pytest

from tallyframe.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    got = registry.QUERIES[name](spark, sf)
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, got.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, found.df().itertuples(index=False, name=None)))


def test_queries_cover_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
