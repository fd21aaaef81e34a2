"""Values that round to zero keep their sign, as in SQL: rows are compared bit by bit."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet

from eospark.jobs.queries import QUERIES, SQL
from eospark.jobs.registry import rounded

NAMES = (
    "add_meta_channel concat_keys concat_satellites det_noise det_resize det_rotate det_select_channels distorted_crop extract_channels "
    "extract_patches match_spatial_dims max_axis merge_dims pad_seq choice reshape_ops det_roll central_crop"
).split()


def write(path, x):
    ids = np.arange(len(x))
    parquet.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": (ids % 10).astype("int32")}), path / "embeddings.parquet")


def same_bits(spark, name, path):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    df = QUERIES[name](spark, str(path))
    want = con.sql(SQL[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    got, want = sorted(repr(tuple(r)) for r in df.collect()), sorted(map(repr, want))
    assert any("-0.0," in r or "-0.0]" in r or "-0.0)" in r for r in want)
    assert got == want


@pytest.fixture(scope="module")
def near_zero(tmp_path_factory):
    """Numbers around half of the last digit, of both signs, and some large ones."""
    path, rng = tmp_path_factory.mktemp("near"), np.random.default_rng(5)
    x = rng.normal(size=(200, 64)) * rng.choice([5e-7, 1e-8, 0.1], (200, 64))
    write(path, x.astype("float32"))
    return path


@pytest.mark.parametrize("name", NAMES)
def test_near_zero(spark, near_zero, name):
    same_bits(spark, name, near_zero)


@pytest.mark.parametrize("name", ["det_resize", "resize_long", "distorted_crop", "match_spatial_dims"])
def test_a_pixel_depends_on_its_neighbours_alone(spark, tmp_path, name):
    """Zeros of both signs; by nearest neighbours also infinite pixels."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 64)) * rng.choice([-0.0, 0.0, 0.1], (200, 64))
    if name in ("distorted_crop", "match_spatial_dims"):
        x[::5, 9], x[1::5, 30], x[2::5, 63] = -np.inf, np.inf, -np.inf
    write(tmp_path, x.astype("float32"))
    same_bits(spark, name, tmp_path)


def test_rounded(spark):
    values = [-1e-9, 1e-9, -0.0, 0.0, -4.9999999e-7, -5e-7, 5e-7, -0.0078125, 0.0078125, float("inf"), -float("inf"), float("nan"), None]
    df = rounded(spark.createDataFrame([(v, [v]) for v in values], "x double, xs array<double>").coalesce(1))
    want = [-0.0, 0.0, -0.0, 0.0, -0.0, -1e-6, 1e-6, -0.007813, 0.007813, float("inf"), -float("inf"), float("nan"), None]
    assert [repr(tuple(r)) for r in df.collect()] == [repr((v, [v])) for v in want]
