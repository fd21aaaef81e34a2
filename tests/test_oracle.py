"""Every registered query of the base library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from eospark.jobs.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
        assert got == sorted((plain(r) for r in want), key=str)
