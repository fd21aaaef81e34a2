"""Operators on examples: properties, errors and edge cases."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eospark.functions import storage
from eospark.functions.arrays import u
from eospark.jobs import pipeline
from eospark.operators import project as P
from eospark.operators import raster as R
from eospark.operators import shaping as S
from eospark.operators.global_order import global_cumsum, global_index
from eospark.sources import files
from eospark.streaming import logs


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_global_index(spark, parts):
    df = spark.range(100).repartition(5).withColumn("k", F.col("id") % 10)
    got = {r["id"]: r["idx"] for r in global_index(df, [F.col("k"), F.col("id")], partitions=parts).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(100), key=lambda i: (i % 10, i))


def test_global_cumsum(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    got = {r["id"]: r["s"] for r in global_cumsum(df, [F.col("id")], {"s": "v"}, partitions=4).collect()}
    assert got == {i: i * (i + 1) for i in range(50)}
    assert global_index(df.where("false"), [F.col("id")]).count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    before = global_index(spark.range(5), [F.col("id")])
    assert before.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        before.count()


def test_filters(spark):
    df = spark.createDataFrame([("a", 1, True, "a"), ("b", 2, False, "a")], "s string, n int, b boolean, t string")
    assert [P.filter_spec(df, x).count() for x in ("", "s=a", "int:n=2", "bool:b=true", "key:s=t", None)] == [2, 1, 1, 1, 1, 2]
    for bad in ("nothing", "what:s=a"):
        with pytest.raises(ValueError):
            P.filter_spec(df, bad)
    with pytest.raises(KeyError):
        P.filter_spec(df, "q=1")


def test_flatten_round_trip(spark):
    df = spark.sql("select named_struct('b', named_struct('c', 1, 'd', named_struct('e', 3))) as a")
    flat = P.flatten_keys(df)
    assert flat.columns == ["a/b/c", "a/b/d/e"] and tuple(flat.first()) == (1, 3)
    assert P.unflatten_keys(flat).schema == df.schema or P.unflatten_keys(flat).first() == df.first()


def test_reverse_mapping():
    with pytest.raises(ValueError):
        P.reverse_mapping({1: ["a"], 2: ["a"]})


def test_remap_ints_raises(spark):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        spark.range(5).select(P.remap_ints(F.col("id"), [1, 2])).collect()


def test_ensure_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        P.ensure_finite(df, ["x"]).collect()
    with pytest.raises(KeyError):
        P.ensure_finite(df, ["y"])


def test_join_checks_ids(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id int, pred double")
    with pytest.raises(ValueError):
        P.join_predictions(a, a.withColumnRenamed("pred", "label"))


def test_pipeline_language(spark):
    assert pipeline.parse("a|b(1, k='x|y')||c([1, 2])") == [("a", [], {}), ("b", [1], {"k": "x|y"}), ("c", [[1, 2]], {})]
    for bad in ("a(", "1+2", "f(g())"):
        with pytest.raises(ValueError):
            pipeline.parse(bad)
    with pytest.raises(KeyError):
        pipeline.preprocess("no_such_op")
    with pipeline.temporary_ops(mine=lambda: lambda df: df.withColumn("d", F.col("__dataset"))):
        out = pipeline.preprocess("mine", dataset="x")(spark.range(1))
    assert out.columns == ["id", "d"] and out.first()["d"] == "x"
    assert not pipeline.known("mine")


def long(spark, a):
    n, h, w = a.shape
    return spark.createDataFrame([(i, y, x, float(a[i, y, x])) for i in range(n) for y in range(h) for x in range(w)], "id int, y int, x int, value double")


def back(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["id"], r["y"], r["x"]] = r["value"]
    return out


def test_flip_rot_against_numpy(spark):
    a = np.arange(5 * 16.0).reshape(5, 4, 4)
    r = [0.05, 0.2, 0.3, 0.45, 0.8]
    col = F.get(F.array(*[F.lit(x) for x in r]), F.col("id"))
    got = back(R.det_flip_rot(long(spark, a), col, 4), a.shape)
    for i, x in enumerate(r):
        want = np.rot90(a[i], int(8 * x) % 4)
        assert (got[i] == (want[:, ::-1] if x > 0.5 else want)).all()


def test_tiles_must_fit(spark):
    with pytest.raises(ValueError):
        R.spatial_tiles(spark.range(1), 3, 4, 4, 8, 8)
    a = np.arange(64.0).reshape(1, 8, 8)
    t = R.spatial_tiles(long(spark, a), 2, 4, 4, 8, 8)
    assert t.count() == 64 and t.select("dx", "dy").distinct().count() == 4


def test_crops_stay_inside(spark):
    a = np.arange(2 * 36.0).reshape(2, 6, 6)
    got = R.det_crop(long(spark, a), F.col("id"), 6, 6, 3, 4).groupBy("id", "crop_id").count().collect()
    assert len(got) == 8 and {r["count"] for r in got} == {9}


def test_resize_methods(spark):
    df = spark.createDataFrame([(0, [float(i) for i in range(16)])], "id int, data array<double>")
    run = lambda m, s: R.resize(df, "data", (4, 4, 1), s, m).first()["data"]
    assert run("nearest", (4, 4)) == run("bilinear", (4, 4)) == run("area", (4, 4)) == [float(i) for i in range(16)]
    assert run("area", (2, 2)) == [2.5, 4.5, 10.5, 12.5]
    assert R.resize_weights(3, 7, "bilinear").sum(axis=1) == pytest.approx(np.ones(7))
    assert R.long_side((10, 20), 5, small=True) == (5, 10)


def test_rotate_quarter(spark):
    a = np.arange(16.0)
    df = spark.createDataFrame([(0, a.tolist(), 0.25), (1, a.tolist(), 0.0)], "id int, data array<double>, r double")
    rows = {r["id"]: np.array(r["data"]).reshape(4, 4) for r in R.det_rotate(df, "data", "r", (4, 4, 1)).collect()}
    assert rows[1].ravel() == pytest.approx(a)
    turned = [np.rot90(a.reshape(4, 4), k) for k in (1, 3)]
    assert any(np.allclose(rows[0], t) for t in turned)


def test_choice_needs_equal_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0])], "id int, a array<double>, b array<double>")
    with pytest.raises(Exception, match="different sizes"):
        df.select(*R.choice(["a", "b"], F.col("id"), 1, "s")).collect()


def test_mixture_shares(spark):
    df = spark.range(4000)
    mixed = S.mixture({"a": df, "b": df}, {"a": 0.5, "b": 2.25})
    n = {r["dataset"]: r["n"] for r in S.mixture_report(mixed).collect()}
    assert abs(n["a"] / 4000 - 0.5) < 0.03 and abs(n["b"] / 4000 - 2.25) < 0.03


def test_shuffle_does_not_depend_on_partitions(spark):
    a = [r["id"] for r in S.shuffle_rows(spark.range(50).repartition(3)).collect()]
    assert a == [r["id"] for r in S.shuffle_rows(spark.range(50).repartition(9)).collect()] != sorted(a)


def test_batches_padding_steps(spark):
    assert S.batch_rows(spark.range(10), 4, [F.col("id")]).count() == 8
    padded = S.pad_eval(spark.range(10), 4)
    assert padded.count() == 12 and padded.where("_mask").count() == 10
    assert S.pad_eval(spark.range(8), 4).count() == 8
    assert [S.steps("epochs", 2, 100, 10), S.steps("examples", 5, 100, 10), S.steps("percent", 0.5, 100, 10, 40)] == [20, 1, 20]


def test_cutmix_keeps_pixels(spark):
    a = np.arange(4 * 16.0).reshape(4, 4, 4)
    df = long(spark, a).selectExpr("0L as batch_id", "id", "y", "x", "id as label", "true as valid", "value")
    out = S.cutmix(df, 4, 4).collect()
    assert len(out) == 64 and {(r["id"], r["y"], r["x"]) for r in out} == {(i, y, x) for i in range(4) for y in range(4) for x in range(4)}
    for r in out:  # label and value always come from the same example
        assert r["value"] == a[r["label"], r["y"], r["x"]]


def test_early_stopping_matches_scan(spark):
    rng = np.random.default_rng(5)
    rows = [(r, "m", s, float(v)) for r in range(3) for s, v in enumerate(rng.random(60), 1)]
    df = spark.createDataFrame(rows, "run int, metric string, step bigint, value double")
    a = sorted(map(tuple, logs.early_stop_windows(df, 7, start=10).collect()))
    b = sorted(map(tuple, logs.early_stop(df, 7, 0.0, start=10).collect()))
    assert a == b


def test_streams_match_tables(spark, tmp_path):
    rows = [(r, "m", s, float((s * 7 + r) % 11)) for r in range(2) for s in range(1, 41)]
    df = spark.createDataFrame(rows, "run int, metric string, step bigint, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    for name, build, mode, want in (
        ("win", lambda s: logs.log_windows(s, 10), "complete", logs.log_windows(df, 10)),
        ("stop", lambda s: logs.early_stop_stream(s, 5, 0.5), "update", logs.early_stop(df, 5, 0.5)),
    ):
        q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_rgb(spark, tmp_path):
    a = np.arange(24).reshape(2, 4, 3)
    (tmp_path / "a.png").write_bytes(png(a))
    r = files.images(spark, str(tmp_path)).first()
    assert (r["height"], r["width"], r["channels"]) == (2, 4, 3) and r["data"] == a.ravel().tolist()


def test_band_stats_files(spark, tmp_path):
    (tmp_path / "s_band_0.json").write_text('{"x": {"mean": 1.5, "n~": 3.0}}')
    (tmp_path / "s_band_1.json").write_text('{"x": {"mean": 2.5}}')
    got = sorted(map(tuple, files.band_stats_json(spark, str(tmp_path / "*.json")).collect()))
    assert got == [("x", 0, "mean", 1.5), ("x", 1, "mean", 2.5)]


def test_lookup_by_line(spark, tmp_path):
    (tmp_path / "names.txt").write_text("b\na\nc\n")
    assert {r["key"]: r["val"] for r in files.lookup_file(spark, str(tmp_path / "names.txt")).collect()} == {"b": 0, "a": 1, "c": 2}


def test_u_is_uniform(spark):
    m = spark.range(20000).select(F.avg(u(F.col("id"), "z")), F.max(u(F.col("id"), "z"))).first()
    assert abs(m[0] - 0.5) < 0.01 and m[1] < 1


def test_metrics_are_saved_whole(spark, tmp_path, monkeypatch):
    from eospark.jobs import data_queries
    from eospark.sources import fixtures

    monkeypatch.setattr(data_queries, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    sf = "/root/testdata/sf0.001"
    assert data_queries.sink_metrics(spark, sf).count()
    saved, log = (sorted(map(tuple, x.select("run", "step", "metric", "value").collect())) for x in (spark.read.parquet(f"file://{tmp_path}/metrics"), fixtures.metric_log(spark, sf)))
    assert saved == log and max(r[1] for r in log) > 20
