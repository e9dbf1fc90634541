"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from lodestack.plans import knowledge, memory, recall, store  # noqa: F401
from lodestack.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(values):
    fix = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted(([fix(v) for v in r] for r in values), key=lambda r: [str(v) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows(df.select(names).collect())
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(want.columns) == names
        assert got == rows(duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall())
