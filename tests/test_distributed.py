"""Hot keys over many partitions, plans without exchanges, and rasters of unlike shapes, against straight computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eospark.operators import confusion, global_order, losses, order_stats, products, project, ragged, raster, regression, shaping
from eospark.streaming import logs
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- Order statistics
@pytest.mark.parametrize("window_rows", [0, 1 << 20])
@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles(spark, window_rows, accuracy):
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 5)) for _ in range(4000)] + [("tied", float(rng.randint(0, 3))) for _ in range(501)]
    rows += [("two", 1.0), ("two", 2.0), ("one", 7.0), ("none", None), (None, 3.0), ("hot", None), ("inf", float("inf")), ("inf", 0.0), ("inf", -float("inf"))]
    df = spark.createDataFrame(rows, "band string, v double").repartition(16)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["band"]: r for r in order_stats.quantiles(df.where("band is not null"), ["band"], "v", probs, window_rows, accuracy).collect()}
    for band in ("hot", "tied", "two", "one"):
        values = [v for b, v in rows if b == band and v is not None]
        assert got[band]["n"] == len(values)
        assert got[band]["q"] == pytest.approx(np.quantile(values, probs).tolist(), abs=1e-12)
    assert "none" not in got and got["inf"]["q"][3] == 0.0
    whole = order_stats.quantiles(df, [], "v", [0.5], window_rows, accuracy).first()
    assert whole["q"][0] == np.median([v for _, v in rows if v is not None])


def test_statistics_have_no_single_reducer(spark):
    """One band over many partitions; no plan gathers values in a percentile."""
    df = spark.range(0, 20000, 1, 32).select(F.lit(0).alias("band"), (F.col("id") * 7919 % 20011).cast("double").alias("value"), F.lit(True).alias("valid"))
    values = np.array([i * 7919 % 20011 for i in range(20000)], float)
    stats = raster.band_stats(df, ["band"], valid=F.col("valid"))
    r = stats.first()
    assert (r["bins_median"], r["n"]) == (np.median(values), 20000)
    assert r["bins_mad_std"] == pytest.approx(np.median(np.abs(values - np.median(values))) * 1.4826)
    columns = shaping.column_stats(df, ["value", "band"])
    assert {r["column"]: r["median"] for r in columns.collect()} == {"value": np.median(values), "band": 0.0}
    scaled = raster.percentile_norm(df, ["band"])
    a, b = np.quantile(values, [0.01, 0.99])
    assert sorted(r["value"] for r in scaled.collect()) == pytest.approx(sorted(np.clip((values - a) / (b - a), 0, 1).tolist()))
    for d in (stats, columns, scaled):
        assert "percentile(" not in plan(d)


# --- Logs
def log_of(spark, n, seed, partitions=13):
    rng = random.Random(seed)
    level, rows = 0.0, []
    for step in range(1, n + 1):
        level += rng.choice([-1, -1, 0, 0.2, 0.6, 1])
        rows.append((1, "m", step * 2, rng.choice([level, float(rng.randint(0, 9))])))
    rows += [(2, "m", 5, 1.0), (3, "m", 1, 2.0), (3, "m", 2, 2.0), (3, "m", 40, 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run int, metric string, step bigint, value double").repartition(partitions), sorted(rows)


@pytest.fixture
def many_ranges(spark):
    """Logs are cut in as many ranges as there are partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def scanned(rows, rule):
    by = {}
    for run, metric, step, value in rows:
        by.setdefault((run, metric), []).append((step, value))
    out = []
    for (run, metric), own in by.items():
        best, step, _, stop = rule.scan(iter(sorted(own)))
        out.append((run, metric, step, best * rule.sign, stop))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_early_stop_of_a_hot_run(spark, many_ranges, seed):
    """One run over many ranges of steps, and runs of a few rows."""
    patience, delta, start, more = [(200, 0.5, 30, True), (60, 0.5, 0, False), (9, 0.0, 500, True), (2000, 3.0, 0, True)][seed]
    df, rows = log_of(spark, 700, seed)
    assert logs.ordered(df, [F.col("run"), F.col("step")]).select("_part").distinct().count() > 8
    rule = logs.EarlyStopping(patience, delta, start, more)
    want = scanned(rows, rule)
    assert sorted(map(tuple, logs.early_stop(df, patience, delta, start, more).collect())) == want
    plain = scanned(rows, logs.EarlyStopping(patience, 0.0, start, more))
    assert sorted(map(tuple, logs.early_stop_windows(df, patience, start, more).collect())) == plain


def test_early_stop_with_nan(spark, many_ranges):
    nan = float("nan")
    rows = [(1, "m", s, v) for s, v in enumerate([1.0, nan, 2.0, *[nan] * 60, 3.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "run int, metric string, step bigint, value double")
    assert [tuple(r) for r in logs.early_stop(df, 100, 0.5).collect()] == [(1, "m", 64, 3.0, None)]
    assert [tuple(r) for r in logs.early_stop(df, 20, 0.5).collect()] == [(1, "m", 3, 2.0, 23)]


def test_progress_and_places_of_a_hot_run(spark, many_ranges):
    df = spark.range(0, 600, 1, 7).select(F.lit(1).alias("run"), (F.col("id") * 3 + 3).alias("step"), (F.col("id") * 2.0).alias("time"))
    df = df.withColumns({"pause": F.lit(0.5), "batch": F.lit(4)})
    got = {r["step"]: r for r in logs.progress(df, 100, 1800).collect()}
    assert got[3]["examples_per_sec"] is None and all(got[s]["examples_per_sec"] == 12 / 1.5 for s in range(6, 1801, 3))
    places = global_order.group_index(df, ["run"], ["step"], "at").select("step", "at").collect()
    assert all(r["at"] == r["step"] // 3 - 1 for r in places)


# --- Metrics
def test_spearman_with_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0.0, 1.0, 2.0, rng.random()]), float(rng.randint(0, 5))) for _ in range(2000)] + [(1.0, 1.0)] * 3000
    p, y = (np.array(x) for x in zip(*rows, strict=True))
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(mean_rank(p), mean_rank(y))[0, 1]
    df = spark.createDataFrame(rows, "pred double, label double").repartition(9)
    assert regression.spearman(df).first()[0] == pytest.approx(want, abs=1e-12)
    assert math.isnan(regression.spearman(df.limit(0)).first()[0])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 199])
def test_ranges_by_bisection(spark, n):
    rng = random.Random(n)
    cuts = sorted({rng.gauss(0, 1) for _ in range(n)})
    values = [*cuts, *[rng.gauss(0, 2) for _ in range(100)], -math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", regression._range_of(F.col("v"), cuts).alias("r"))
    assert [r["r"] for r in df.collect()] == [int(np.searchsorted(cuts, v)) for v in values]
    assert spark.createDataFrame([(math.nan,)], "v double").select(regression._range_of(F.col("v"), cuts)).first()[0] == len(cuts)


def test_spearman_over_many_ranges(spark, many_ranges):
    """Half of the rows share a value, some are NaN (the largest); a value is not compared with each range's bound."""
    rng = random.Random(8)
    rows = [(rng.choice([0.5, rng.gauss(0, 1)]), rng.gauss(0, 1)) for _ in range(3000)]
    rows = [(p, y + p) for p, y in rows] + [(math.nan, rng.random()) for _ in range(300)]
    p, y = (np.array([math.inf if v != v else v for v in x]) for x in zip(*rows, strict=True))
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    got = regression.spearman(spark.createDataFrame(rows, "pred double, label double").repartition(9))
    assert got.first()[0] == pytest.approx(np.corrcoef(mean_rank(p), mean_rank(y))[0, 1], abs=1e-12)
    assert "filter(" not in plan(got)


def test_rolling_max_in_the_row(spark):
    df = spark.createDataFrame([([3, 1, 5, 2, 4, 9],)], "labels array<int>")
    for window, want in ((1, [3, 1, 5, 2, 4, 9]), (3, [5, 2, 5, 9, 5, 9]), (5, [5, 9, 5, 9, 5, 9])):
        assert df.select(confusion.rolling_max_in_row(F.col("labels"), window, 2)).first()[0] == want
    with pytest.raises(ValueError):
        confusion.rolling_max_in_row(F.col("labels"), 2, 1)


def test_no_shuffle_within_rows(spark):
    df = __spark_entry__.queries()["cm3d_rolling_max"](spark, SF)
    assert "Window" not in plan(df)
    voted = __spark_entry__.queries()["panoptic_post"](spark, SF)
    assert "Exchange" not in plan(voted)


def test_panoptic_votes(spark):
    semantics, instances = [[1.0, 0.0], [0.0, 5.0], [3.0, 0.0], [2.0, 0.0]], [[0.0, 9.0], [0.0, 9.0], [0.0, 9.0], [4.0, 1.0]]
    df = spark.createDataFrame([(semantics, instances), ([], [])], "s array<array<double>>, i array<array<double>>")
    got = [r["v"].asDict() for r in df.select(products.panoptic(F.col("s"), F.col("i"), 0.25).alias("v")).collect()]
    assert got == [{"instance": [1, 1, 1, 0], "class": [1, 1, 1, 0]}, {"instance": [], "class": []}]


# --- Joins
def test_bucketed_join_needs_no_exchange(spark):
    preds = spark.range(0, 1000, 1, 5).select("id", (F.col("id") * 0.5).alias("pred"))
    labels = spark.range(500, 1500, 1, 3).select("id", F.col("id").alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = project.join_unique(project.save_bucketed(preds, "id", 4), project.save_bucketed(labels, "id", 4))
        assert both.count() == 500 and "Exchange" not in plan(both)
        twice = project.save_bucketed(preds.unionAll(preds.where("id = 700")), "id", 4)
        with pytest.raises(Exception, match="id is not unique: 700"):
            project.join_unique(twice, labels).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# --- Losses
def slow_nt_xent(v, temperature):
    sim = v @ v.T / temperature
    np.fill_diagonal(sim, -np.inf)
    top = sim.max(axis=1, keepdims=True)
    lse = top[:, 0] + np.log(np.exp(sim - top).sum(axis=1))
    i = np.arange(len(v))
    each = lse - sim[i, i ^ 1]
    return each[::2] + each[1::2]


@pytest.mark.parametrize("pairs,block", [(1, 256), (300, 32), (700, 256)])
def test_nt_xent_in_blocks(spark, pairs, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2 * pairs, 6)) * 3
    rows = [(5, i // 2, i % 2, x.tolist()) for i, x in enumerate(v)] + [(5, 10_000, 0, [1.0] * 6), (6, 0, 1, [0.5] * 6), (6, 0, 0, [0.1] * 6)]
    df = spark.createDataFrame(rows, "batch_id bigint, pair bigint, view int, v array<double>")
    got = {(r["batch_id"], r["pair"]): r["loss"] for r in losses.nt_xent(df, temperature=0.7, block=block).collect()}
    want = slow_nt_xent(v, 0.7)
    assert len(got) == pairs + 1 and np.allclose([got[5, i] for i in range(pairs)], want)
    assert got[6, 0] == pytest.approx(0.0)


def test_nt_xent_of_a_large_batch(spark):
    """20 000 pairs: 1.6 billion similarities, a block pair at a time."""
    df = spark.range(0, 40_000, 1, 8).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.expr("id div 2").alias("pair"), (F.col("id") % 2).cast("int").alias("view"),
        F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("v"),
    )
    i = np.arange(40_000, dtype=float)
    v = np.stack([np.sin(i), np.cos(i), np.sin(i * 3)], axis=1)
    got = {r["pair"]: r["loss"] for r in losses.nt_xent(df, block=512).where("pair % 4000 = 0").collect()}
    for p in range(0, 20_000, 4000):
        want = 0.0
        for k in (2 * p, 2 * p + 1):
            sim = v @ v[k]
            want += np.log(np.exp(np.delete(sim, k)).sum()) - sim[k ^ 1]
        assert got[p] == pytest.approx(want)


# --- Rasters of unlike shapes
def test_resample(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((h, w, c)) * 400 - 50 for h, w, c in [(4, 6, 2), (4, 6, 2), (5, 3, 1), (1, 1, 3)]]
    rows = [(i, list(x.shape), x.ravel().tolist(), [float(k % 2) for k in range(x.shape[0] * x.shape[1])], "keep") for i, x in enumerate(images)]
    rows.append((9, [2, 2, 1], None, None, None))
    df = spark.createDataFrame(rows, "id int, shape array<int>, data array<double>, mask array<double>, extra string")
    df = df.withColumn("size", ragged.by_side(F.col("shape"), 2, True))
    got = {r["id"]: r for r in ragged.resample(df, {"data": ("bilinear", "uint8"), "mask": ("nearest", None)}, "size").collect()}
    for i, x in enumerate(images):
        h, w, c = x.shape
        nh, nw = (round(n * 2 / min(h, w)) for n in (h, w))
        want = np.zeros((nh, nw, c))
        for a in range(nh):
            for b in range(nw):
                y, z = (min(max((k + 0.5) * n / m - 0.5, 0), n - 1) for k, n, m in ((a, h, nh), (b, w, nw)))
                y0, z0 = int(y), int(z)
                y1, z1 = min(y0 + 1, h - 1), min(z0 + 1, w - 1)
                want[a, b] = (1 - y + y0) * ((1 - z + z0) * x[y0, z0] + (z - z0) * x[y0, z1]) + (y - y0) * ((1 - z + z0) * x[y1, z0] + (z - z0) * x[y1, z1])
        assert got[i]["shape"] == [nh, nw, c] and got[i]["extra"] == "keep"
        assert got[i]["data"] == np.trunc(np.clip(want, 0, 255)).ravel().tolist()
        mask = np.array(rows[i][3]).reshape(h, w)
        assert got[i]["mask"] == [mask[int((a + 0.5) * h / nh), int((b + 0.5) * w / nw)] for a in range(nh) for b in range(nw)]
    assert got[9]["data"] is None and got[9]["shape"] == [2, 2, 1]


def test_distorted_boxes_fit(spark):
    shape = F.array(*[(F.col("id") % n + 1).cast("int") for n in (7, 11)], F.lit(1))
    df = spark.range(500).select("id", shape.alias("shape"), ragged.distorted_box(shape, F.col("id"), "s").alias("box"))
    shares = []
    for r in df.collect():
        y, x, h, w = r["box"]
        assert 1 <= h and y >= 0 and y + h <= r["shape"][0] and 1 <= w and x >= 0 and x + w <= r["shape"][1]
        shares.append(h * w / (r["shape"][0] * r["shape"][1]))
    assert 0.3 < np.mean(shares) < 0.8


def test_shift_reflects(spark):
    x = np.arange(24).reshape(3, 4, 2)
    df = spark.createDataFrame([(x.ravel().tolist(), dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)], "data array<bigint>, dy int, dx int")
    padded = np.pad(x, [(2, 2), (2, 2), (0, 0)], mode="reflect")
    shape = F.array(F.lit(3), F.lit(4), F.lit(2))
    for r in df.select("dy", "dx", ragged.shift_reflect(F.col("data"), shape, F.col("dy"), F.col("dx")).alias("out")).collect():
        assert r["out"] == padded[2 + r["dy"] : 5 + r["dy"], 2 + r["dx"] : 6 + r["dx"]].ravel().tolist()


def test_ratios_keep_the_aspect(spark):
    df = spark.createDataFrame([([8, 4, 1], 0.0), ([8, 4, 1], 0.99), ([3, 9, 1], 0.5)], "shape array<int>, r double")
    got = [r[0] for r in df.select(ragged.by_reference(F.col("shape"), F.col("r"), 10, 0.5, 1.5)).collect()]
    assert got == [[5, 2], [14, 7], [3, 10]]
