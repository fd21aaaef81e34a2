"""Hand-made cases with known results. Inputs and results here are fixed values: they must equal published ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eospark.functions.arrays import argmax, div0, log_softmax, one_hot, softmax, u
from eospark.operators import confusion as C
from eospark.operators import losses as L
from eospark.operators import regression as R
from eospark.operators import threshold as T


def grid(df, n):
    out = [[0] * n for _ in range(n)]
    for r in df.collect():
        out[r["pred"]][r["true"]] = r["n"]
    return out


PROBS = [[0.9, 0.0, 0.1], [0.8, 0.1, 0.1], [0.1, 0.2, 0.7], [0.1, 0.2, 0.7], [0.3, 0.3, 0.4]]


def scores(spark, labels, probs, **more):
    rows = [(i, y, p, *(v[i] for v in more.values())) for i, (y, p) in enumerate(zip(labels, probs, strict=True))]
    return spark.createDataFrame(rows, "id int, label int, logits array<double>" + "".join(f", {k} double" for k in more))


def test_confusion(spark):
    df = scores(spark, [0, 1, 2, 2, 0], PROBS)
    cm = C.confusion_matrix(df, 3)
    assert grid(cm, 3) == [[1, 1, 0], [0, 0, 0], [1, 0, 2]]
    both = cm.unionByName(cm).groupBy("pred", "true").agg(F.sum("n").alias("n"))
    assert grid(both, 3) == [[2, 2, 0], [0, 0, 0], [2, 0, 4]]


def test_confusion_without_background(spark):
    df = scores(spark, [0, 1, 2, 0], [PROBS[0], PROBS[1], PROBS[2], PROBS[4]])
    cm = C.confusion_matrix(df, 3, keep=F.col("label") > 0)
    assert grid(cm, 3) == [[0, 1, 0], [0, 0, 0], [0, 0, 1]]
    assert C.macro_metrics(cm, exclude_background=True).first()["miou"] == 0.5


@pytest.mark.parametrize(
    "w,want", [(1, [0, 1, 0, 1, 2, 2, 0, 1]), (3, [1, 1, 1, 2, 2, 2, 2, 1]), (5, [1, 1, 2, 2, 2, 2, 2, 2])]
)
def test_rolling_max(spark, w, want):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([0, 1, 0, 1, 2, 2, 0, 1])], "id int, t int, label int")
    got = C.rolling_max(df, w, ["id"]).orderBy("t").collect()
    assert [r["label"] for r in got] == want


def test_rolling_max_is_odd(spark):
    with pytest.raises(ValueError):
        C.rolling_max(spark.range(1), 2, ["id"])


def test_smape_bias_and_others(spark):
    m = R.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 1.0)], "pred double, label double"))
    assert m.first()["smape"] == pytest.approx(8 / 9, abs=1e-6)
    m = R.regression_metrics(spark.createDataFrame([(10.0, 15.0), (20.0, 25.0), (30.0, 35.0)], "pred double, label double")).first()
    assert (m["bias"], m["mse"], m["rmse"]) == (-5, 25, 5)


def test_r2(spark):
    df = spark.createDataFrame([(15.0, 10.0, 0.5), (25.0, 20.0, 1.0), (35.0, 30.0, 0.5)], "pred double, label double, w double")
    assert R.r2(df).first()[0] == pytest.approx(0.625)
    assert R.r2(df, weight=F.col("w")).first()[0] == pytest.approx(0.5)
    assert math.isnan(R.r2(df.limit(1)).first()[0])


def test_stratified_mae(spark):
    rows = [(i * 1.1, float(i), float(i), k) for i, k in zip(range(1, 7), [1.0, 2.0, 3.0, 4.0, 5.0, 9.0], strict=True)]
    df = spark.createDataFrame(rows, "pred double, label double, key1 double, key2 double")
    got = {(r["key1_bin"], r["key2_bin"]): (round(r["value"], 6), r["n"]) for r in R.stratified(df, "mae", {"key1": [0, 2.5, 5, 7], "key2": [0, 3.5, 7]}).collect()}
    want = {(0, 0): (0.15, 2), (0, 1): (0.0, 0), (1, 0): (0.3, 1), (1, 1): (0.4, 1), (2, 0): (0.0, 0), (2, 1): (0.5, 1)}
    assert got == want


def test_stratified_pearson(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.5, 6.0, 6.5], [1.1, 2.1, 4.0, 3.0, 5.0, 6.5, 6.0], strict=True)), "pred double, label double")
    got = [r["value"] for r in R.stratified(df.withColumn("k", F.col("label")), "pearson", {"k": [0, 2.5, 5, 7]}).orderBy("k_bin").collect()]
    assert got == pytest.approx([1, -1, 0.65465367])


def test_strata_confusion(spark):
    df = scores(spark, [4, 2], [[1.0, 2.0, 10.0, 5.5, 7.5], [10.0, 4.0, 2.0, 1.0, 7.0]], strata=[2.0, 1.0])
    got = {(int(r["strata"]), r["pred"], r["true"]) for r in C.confusion_matrix(df, 5, ["strata"]).where("n = 1").collect()}
    assert got == {(1, 0, 2), (2, 2, 4)}


def test_logvar(spark):
    df = spark.createDataFrame([(-10.0, 0.0), (20.0, 0.2), (30.0, 0.8)], "v double, w double")
    r = R.log_variance_range(df, F.col("v"), F.col("w")).first()
    assert (r["min_logvar"], r["max_logvar"]) == (20, 30)
    r = R.log_variance_range(df.where("false"), F.col("v"), F.col("w")).first()
    assert (r["min_logvar"], r["max_logvar"]) == (math.inf, -math.inf)


def test_partial_label_loss(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0, 1]), ([1.0, 0.0], [1, 1])], "z array<double>, y array<int>")
    got = [r[0] for r in df.select(L.partial_label_loss(F.col("z"), F.col("y"), entropy_weight=0.0)).collect()]
    assert got == pytest.approx([0.3132616, 0], abs=1e-6)


def test_smape_loss(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (0, 2.0, 1.0, 1.0), (1, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0)], "id int, p double, y double, w double")
    loss = L.smape_loss(F.col("p"), F.col("y"))
    got = [r["loss"] for r in L.weighted_mean(df, "id", loss).orderBy("id").collect()]
    assert got == pytest.approx([1 / 3, 1], abs=1e-6)
    got = [r["loss"] for r in L.weighted_mean(df, "id", loss, F.col("w")).orderBy("id").collect()]
    assert sum(got) / 2 == pytest.approx(1 / 6, abs=1e-6)


def test_weight_zero_is_finite(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0)], "id int, p double, w double")
    assert L.weighted_mean(df, "id", F.col("p"), F.col("w")).first()["loss"] == 0


@pytest.mark.parametrize("norm", ["standard", "squared", "tanimoto", "tversky"])
def test_dice_against_numpy(spark, norm):
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(size=(9, 4)), rng.integers(0, 4, 9), rng.integers(0, 2, 9)
    df = spark.createDataFrame([(0, z[i].tolist(), int(y[i]), float(w[i])) for i in range(9)], "id int, logits array<double>, label int, w double")
    got = L.generalized_dice(df, "id", softmax(F.col("logits")), one_hot(F.col("label"), 4), F.col("w"), norm_type=norm, dual=True).first()["loss"]
    k = w > 0
    p, t = (np.exp(z) / np.exp(z).sum(1, keepdims=True))[k], np.eye(4)[y][k]

    def coef(p, t):
        i = 2 * (p * t).sum(0)
        n = {"standard": p + t, "squared": p**2 + t**2, "tanimoto": 2 * (p**2 + t**2 - p * t), "tversky": 2 * (0.3 * p**2 + 0.7 * t**2)}[norm].sum(0)
        return ((i + 1e-3) / (n + 1e-3)).mean()

    assert got == pytest.approx(1 - (coef(p, t) + coef(1 - p, 1 - t)) / 2)


def test_nt_xent(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 2, 5))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    df = spark.createDataFrame([(0, p, k, v[p, k].tolist()) for p in range(6) for k in range(2)], "batch_id bigint, pair bigint, view int, v array<double>")
    got = [r["loss"] for r in L.nt_xent(df, temperature=0.1).orderBy("pair").collect()]
    x = v.reshape(12, 5)
    s = x @ x.T / 0.1
    np.fill_diagonal(s, -1e10)
    each = np.log(np.exp(s).sum(1)) - s[np.arange(12), np.arange(12) ^ 1]
    assert got == pytest.approx(each.reshape(6, 2).sum(1).tolist())


def test_thresholds_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(200), np.array(T.GRID), [0.0, 1.0, 0.5, math.nan, -1.0, 2.0]])
    df = spark.createDataFrame([(float(x),) for x in p], "p double").select("p", T.above(F.col("p")).alias("b"))
    for r in df.collect():
        assert r["b"] == sum(t < r["p"] for t in T.GRID)


def test_roc_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1)], "s double, y int")
    assert T.roc_auc(df, F.col("s"), F.col("y") == 1).first()[0] == pytest.approx((1 + 0.5 + 2 + 2) / 6)
    assert math.isnan(T.roc_auc(df.where("y = 1"), F.col("s"), F.col("y") == 1).first()[0])


def test_spearman_ties(spark):
    p, y = [1.0, 2.0, 2.0, 3.0, 5.0], [2.0, 1.0, 3.0, 3.0, 9.0]
    ra, rb = np.array([1, 2.5, 2.5, 4, 5]), np.array([2, 1, 3.5, 3.5, 5])
    got = R.spearman(spark.createDataFrame(list(zip(p, y, strict=True)), "pred double, label double")).first()[0]
    assert got == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_portable_uniform(spark):
    assert spark.range(1, 2).select(u(F.col("id"), "a")).first()[0] == 0.1721359477378428


def test_guarded_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(div0(F.col("a"), F.col("b"))).collect()] == [0, math.inf, -math.inf, 0.5]


def test_argmax_takes_first_and_nan(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1.0, math.nan, 3.0],)], "z array<double>")
    assert [r[0] for r in df.select(argmax(F.col("z"))).collect()] == [1, 1]


def test_log_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 0.0],)], "z array<double>")
    assert df.select(log_softmax(F.col("z"))).first()[0] == pytest.approx([0, -1000])


def test_stratified_accuracy_by_hand(spark):
    cm = spark.createDataFrame([(0, 0, 0, 8), (0, 0, 1, 2), (0, 1, 0, 0), (0, 1, 1, 0), (1, 0, 0, 1), (1, 0, 1, 0), (1, 1, 0, 1), (1, 1, 1, 8)], "strata int, pred int, true int, n bigint")
    got = {r["metric"]: r["value"] for r in C.stratified_accuracy(cm, {0: 100.0, 1: 300.0}).collect()}
    assert got["stratified/oa"] == pytest.approx((0.8 * 100 + 0.9 * 300) / 400)
    assert got["stratified/class_1_ua"] == pytest.approx((0.8 * 300) / (0.9 * 300))
    assert got["stratified/class_1_pa"] == pytest.approx((0.8 * 300) / (0.2 * 100 + 0.8 * 300))
    assert got["stratified/class_1_area"] == pytest.approx((0.2 * 100 + 0.8 * 300) / 400)
    v = [100**2 * 0.9 * (0.8 * 0.2 * 10 / 9) / 10, 300**2 * (1 - 10 / 300) * (0.9 * 0.1 * 10 / 9) / 10]
    assert got["stratified/oa_se"] == pytest.approx(math.sqrt(sum(v)) / 400)
    reduced = C.reduce_classes(cm, {0: 0, 1: 0})
    assert {r["n"] for r in reduced.collect()} == {10}
