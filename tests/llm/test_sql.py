"""Operators with SQL give DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from lodestack.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_vector_codes", "op13_merkle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(Q.oracle_sql()[name])
    columns = sorted(want.columns)
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]})").fetchall())
