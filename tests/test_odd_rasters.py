"""Rasters with nulls, of other lengths, not finite or very large: rows are compared with SQL bit by bit."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet

from eospark.jobs.queries import QUERIES, SQL
from eospark.jobs.registry import rounded


def same_bits(spark, name, path, rows):
    rows = [None if r is None else [None if v is None else float(v) for v in r] for r in rows]
    ids = range(len(rows))
    parquet.write_table(
        pa.table({"vec_id": pa.array(ids, "int64"), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([i % 10 for i in ids], "int32")}),
        path / "embeddings.parquet",
    )
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    df = QUERIES[name](spark, str(path))
    want = con.sql(SQL[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


def odd():
    """Null, empty, short and long arrays, null elements, NaN and infinite ones."""
    x = np.random.default_rng(11).normal(size=(60, 64)).astype("float32")
    x[20:30][:, ::7], x[30:40, 9], x[40:50, 30] = np.nan, np.inf, -np.inf
    rows = [list(r) for r in x]
    for i in range(10, 20):
        rows[i][i], rows[i][i + 8 :: 2] = None, [None] * len(rows[i][i + 8 :: 2])
    return rows + [None, [], rows[0][:48], rows[1][:1], [*rows[2], 1.0, 2.0, 3.0, 4.0]]


def large():
    rng = np.random.default_rng(12)
    return (rng.normal(size=(200, 64)) * 10.0 ** rng.integers(-8, 30, (200, 64))).astype("float32")


@pytest.mark.parametrize("name", ["det_rotate", "det_noise", "concat_keys", "concat_satellites", "det_select_channels", "extract_channels", "select_channels", "extract_patches", "max_axis", "merge_dims", "reshape_ops"])
def test_odd(spark, tmp_path, name):
    same_bits(spark, name, tmp_path, odd())


@pytest.mark.parametrize("name", ["det_rotate", "det_noise"])
def test_large(spark, tmp_path, name):
    same_bits(spark, name, tmp_path, large())


def test_rounding_rule(spark):
    """Decimals that end in 5 and are stored a little below or above, large numbers, what overflows."""
    values = [(2 * k + 1) / 2e6 * s for k in range(2000) for s in (1, -1)] + [1.005, 6115174582.5683365, 2.0**52 / 1e6, 1e300, 1e305, -1e308, 1e-320]
    df = rounded(spark.createDataFrame([(v, [v]) for v in values], "x double, xs array<double>").coalesce(1))
    want = duckdb.sql("select round(x, 6), [round(x, 6)] from (select unnest($1::DOUBLE[]) as x)", params=[values]).fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))
