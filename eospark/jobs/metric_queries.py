"""Registered queries: metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import argmax, softmax
from eospark.jobs.registry import query, rounded
from eospark.operators import confusion as C
from eospark.operators import regression as R
from eospark.operators import threshold as T
from eospark.sources import fixtures as X

_ARG = "list_position(logits, list_max(logits))-1"
_CM = f", cm AS (SELECT p.i AS pred, t.i AS true, count(s.id) AS n FROM range(10) p(i) CROSS JOIN range(10) t(i) LEFT JOIN (SELECT * FROM scored_cls WHERE mask AND weight > 0) s ON {_ARG} = p.i AND label = t.i GROUP BY ALL)"
_CLS = _CM + ", c AS (SELECT k.i AS class, sum(n) FILTER (pred = k.i AND \"true\" = k.i) AS tp, sum(n) FILTER (pred = k.i) AS p, sum(n) FILTER (\"true\" = k.i) AS t, sum(n) AS total FROM cm, range(10) k(i) GROUP BY ALL)"


def _cls_cm(spark, d) -> DataFrame:
    keep = F.col("mask") & (F.col("weight") > 0)
    return C.confusion_matrix(X.scored_cls(spark, d), 10, keep=keep)


@query("scored_cls", _CM + " SELECT pred::INT AS pred, \"true\"::INT AS true, n::BIGINT AS n FROM cm")
def confusion_matrix(spark, d):
    return _cls_cm(spark, d)


def _grid(keys: str, key_table: str, n: int, source: str, pred: str, on: str) -> str:
    return f" SELECT {keys}, p.i::INT AS pred, q.i::INT AS true, count(s.id)::BIGINT AS n FROM {key_table} k CROSS JOIN range({n}) p(i) CROSS JOIN range({n}) q(i) LEFT JOIN {source} s ON {on} AND {pred} = p.i AND s.label = q.i GROUP BY ALL"


@query("scored_t", _grid("k.t", "(SELECT DISTINCT t FROM scored_t)", 4, "scored_t", "list_position(s.logits, list_max(s.logits))-1", "s.t = k.t"))
def confusion_matrix_3d(spark, d):
    return C.confusion_matrix(X.scored_t(spark, d), 4, ["t"])


@query(
    "scored_t",
    ", r AS (SELECT id, t, y, x, logits, greatest(max(label) OVER w, CASE WHEN t IN (0, 3) THEN 0 ELSE -1 END) AS label FROM scored_t WINDOW w AS (PARTITION BY id, y, x ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
    + _grid("k.t", "(SELECT DISTINCT t FROM scored_t)", 4, "r", "list_position(s.logits, list_max(s.logits))-1", "s.t = k.t"),
)
def cm3d_rolling_max(spark, d):
    df = X.rasters_of(X.table(spark, d, "embeddings"), 4, 2, 2, 4)
    cells = F.arrays_zip(C.rolling_max_in_row(F.col("labels"), 3, 4).alias("label"), F.col("logits"))
    rows = df.select(F.posexplode(cells).alias("p", "cell")).select(F.expr("cast(p div 4 as int)").alias("t"), "cell.label", "cell.logits")
    return C.confusion_matrix(rows, 4, ["t"])


_STRATA = ", s0 AS (SELECT * FROM scored_cls WHERE label > 0)" + _grid("k.strata", "(SELECT DISTINCT strata FROM scored_cls)", 10, "s0", "list_position(s.logits, list_max(s.logits))-1", "s.strata = k.strata")


@query("scored_cls", _STRATA)
def strata_cm(spark, d):
    return C.confusion_matrix(X.scored_cls(spark, d), 10, ["strata"], keep=F.col("label") > 0)


_SOFTMAX = "list_transform(logits, lambda z: exp(z - list_max(logits)) / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))))"


@query("scored_cls", f", b AS (SELECT id, strata, (label IN (1, 2))::INT AS label, CASE WHEN ({_SOFTMAX})[2] + ({_SOFTMAX})[3] >= 0.5 THEN 1 ELSE 0 END AS pr FROM scored_cls)" + _grid("k.strata", "(SELECT DISTINCT strata FROM scored_cls)", 2, "b", "s.pr", "s.strata = k.strata"))
def strata_binary_cm(spark, d):
    df = X.scored_cls(spark, d).withColumn("probs", softmax(F.col("logits")))
    return C.binary_by_stratum(df, [1, 2], 0.5, ["strata"], "probs")


_EDGES = [0.0, 10.0, 20.0, 40.0, 60.0]
_BIN = "greatest(" + "+".join(f"({{0}} >= {e})::INT" for e in _EDGES) + "-1, 0)"


@query("scored_reg", f", b AS (SELECT 1 AS id, {_BIN.format('pred')} AS pr, {_BIN.format('label')} AS label FROM scored_reg)" + _grid("1 AS one", "(SELECT 1)", 5, "b", "s.pr", "true").replace("1 AS one, ", ""))
def strat_regression_cm(spark, d):
    return R.confusion_by_bins(X.scored_reg(spark, d), _EDGES)


_MACRO = {
    "miou": "avg(tp / nullif(p + t - tp, 0))", "f1_macro": "avg(2*tp / nullif(p + t, 0))",
    "precision_macro": "avg(tp / nullif(p, 0))", "recall_macro": "avg(tp / nullif(t, 0))",
}
for _name, _expr in _MACRO.items():
    query("scored_cls", _CLS + f" SELECT round({_expr}, 6) AS {_name} FROM c", name=_name)(
        lambda spark, d, n=_name: rounded(C.macro_metrics(_cls_cm(spark, d)).select(n))
    )


@query("scored_cls", _CLS + " SELECT 'per_class/0' || class || '_cls' || class || '_' || m AS metric, round(CASE m WHEN 'f1' THEN coalesce(2*tp/nullif(p+t,0),0) WHEN 'prec' THEN coalesce(tp/nullif(p,0),0) WHEN 'recall' THEN coalesce(tp/nullif(t,0),0) WHEN 'iou' THEN coalesce(tp/nullif(p+t-tp,0),0) WHEN 'acc' THEN (total-p-t+2*tp)/total ELSE t/total END, 6) AS value FROM c, (SELECT unnest(['f1','prec','recall','iou','acc','fraction']) AS m)")
def per_class(spark, d):
    return rounded(C.per_class(_cls_cm(spark, d), classes=10, metrics=C.PER_CLASS))


_ACC_SQL = """, h AS (SELECT strata AS s, count(*)::DOUBLE AS n FROM scored_cls WHERE label > 0 GROUP BY ALL),
w AS (SELECT s, n, (s+1)*5000.0::DOUBLE AS w FROM h),
pt AS (SELECT strata AS s, """ + _ARG + """ AS pred, label AS true FROM scored_cls WHERE label > 0),
c AS (SELECT w.s, w.n, w.w, k.i AS class, count(*) FILTER (pred = k.i AND "true" = k.i)::DOUBLE AS tp, count(*) FILTER (pred = k.i)::DOUBLE AS p, count(*) FILTER ("true" = k.i)::DOUBLE AS t FROM w JOIN pt USING (s), range(10) k(i) GROUP BY ALL),
o AS (SELECT s, n, w, sum(tp) AS tp FROM c GROUP BY ALL),
tw AS (SELECT sum(w) AS tw FROM w),
q AS (SELECT class, sum(tp*w/n) AS nom, sum(p*w/n) AS ud, sum(t*w/n) AS pd, sum(t) AS nt, sum(p) AS np, sum(tp) AS ntp FROM c GROUP BY ALL),
r AS (SELECT *, CASE WHEN ud = 0 THEN 'nan'::DOUBLE ELSE nom/ud END AS ua, CASE WHEN pd = 0 THEN 'nan'::DOUBLE ELSE nom/pd END AS pa FROM q),
e AS (SELECT class, sum(w*w*(1-n/w)/n * ((tp-tp*tp/n) + ua*ua*(p-p*p/n) - 2*ua*(tp-tp*p/n))/(n-1)) AS uv, sum(w*w*(1-n/w)/n * ((tp-tp*tp/n) + pa*pa*(t-t*t/n) - 2*pa*(tp-tp*t/n))/(n-1)) AS pv, sum(w*w*(1-n/w)/n*(t-t*t/n)/(n-1)) AS av FROM c JOIN r USING (class) GROUP BY ALL),
f AS (SELECT *, CASE WHEN ua+pa = 0 THEN 'nan'::DOUBLE ELSE 2*ua*pa/(ua+pa) END AS f1, CASE WHEN np = 0 THEN 'nan'::DOUBLE ELSE ntp/np END AS nua, CASE WHEN nt = 0 THEN 'nan'::DOUBLE ELSE ntp/nt END AS npa FROM r JOIN e USING (class), tw)
SELECT 'stratified/' || metric AS metric, round(value, 6) AS value FROM (
SELECT 'oa' AS metric, sum(tp/n*w)/any_value(tw) AS value FROM o, tw
UNION ALL SELECT 'ns_oa', sum(tp)/sum(n) FROM o
UNION ALL SELECT 'oa_se', sqrt(sum(w*w*(1-n/w)/n*(tp-tp*tp/n)/(n-1)))/any_value(tw) FROM o, tw
UNION ALL SELECT 'f1_macro', avg(f1) FROM f
UNION ALL SELECT unnest(['class_'||class||'_ua','class_'||class||'_ua_se','class_'||class||'_pa','class_'||class||'_pa_se','class_'||class||'_f1','ns_class_'||class||'_ua','ns_class_'||class||'_pa','ns_class_'||class||'_f1','class_'||class||'_area','class_'||class||'_area_se']),
 unnest([ua, CASE WHEN ud > 0 AND uv >= 0 THEN sqrt(uv)/ud ELSE 'nan'::DOUBLE END, pa, CASE WHEN pd > 0 AND pv >= 0 THEN sqrt(pv)/pd ELSE 'nan'::DOUBLE END, f1, nua, npa, CASE WHEN nua+npa = 0 THEN 'nan'::DOUBLE ELSE 2*nua*npa/(nua+npa) END, pd/tw, CASE WHEN av >= 0 THEN sqrt(av)/tw ELSE 'nan'::DOUBLE END]) FROM f)"""


@query("scored_cls", _ACC_SQL)
def stratified_accuracy(spark, d):
    cm = C.confusion_matrix(X.scored_cls(spark, d), 10, ["strata"], keep=F.col("label") > 0)
    return rounded(C.stratified_accuracy(cm, {s: (s + 1) * 5000.0 for s in range(4)}))


@query("scored_cls", f"SELECT round(avg(({_ARG} = label)::INT), 6) AS accuracy FROM scored_cls WHERE mask")
def accuracy(spark, d):
    df = X.scored_cls(spark, d).where("mask")
    return rounded(df.agg(F.avg((argmax(F.col("logits")) == F.col("label")).cast("int")).alias("accuracy")))


@query("scored_cls", f"SELECT round(avg(({_ARG} IN (label, (label+1)%10))::INT), 6) AS accuracy_partial_multilabel FROM scored_cls WHERE mask")
def accuracy_partial_multilabel(spark, d):
    df = X.scored_cls(spark, d).where("mask")
    allowed = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i.isin(F.col("label"), (F.col("label") + 1) % 10)).cast("double"))
    return rounded(df.agg(F.avg(F.get(allowed, argmax(F.col("logits")))).alias("accuracy_partial_multilabel")))


# Thresholds
_THR = ", thr AS (SELECT i, CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1+1e-7 ELSE i/199.0::DOUBLE END AS thr FROM range(200) r(i)), m AS (SELECT id, k.i AS class, labels[k.i+1] AS label, predictions[k.i+1] AS pred, weight FROM scored_multilabel, range(2) k(i) WHERE mask), ct AS (SELECT class, i, sum(weight*label*(pred > thr)::INT) AS tp, sum(weight*(1-label)*(pred > thr)::INT) AS fp, sum(weight*label*(pred <= thr)::INT) AS fn, sum(weight*(1-label)*(pred <= thr)::INT) AS tn FROM m, thr GROUP BY ALL), mi AS (SELECT i, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ct GROUP BY ALL)"


def _multilabel(spark, d) -> DataFrame:
    rows = T.exploded(X.scored_multilabel(spark, d).where("mask"), keep=["weight"])
    return T.counts_by_threshold(rows, F.col("weight"))


@query("scored_multilabel", _THR + " SELECT class::INT AS class, i::INT AS i, tp, fp, fn, tn FROM ct")
def cm_multilabel(spark, d):
    return _multilabel(spark, d)


def _area_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f", l AS (SELECT {k}i, tp, tp+fp AS p, lead(tp) OVER w AS tp2, lead(tp+fp) OVER w AS p2, lead(fn) OVER w AS fn2 FROM {source} WINDOW w AS ({part}ORDER BY i)), sl AS (SELECT *, CASE WHEN greatest(p-p2,0) > 0 THEN (tp-tp2)/(p-p2) ELSE 0 END AS slope FROM l WHERE tp2 IS NOT NULL), ar AS (SELECT {k}sum(CASE WHEN tp2+fn2 > 0 THEN slope*(tp-tp2+(tp2-slope*p2)*ln(CASE WHEN p > 0 AND p2 > 0 THEN p/p2 ELSE 1 END))/(tp2+fn2) ELSE 0 END) AS aucpr FROM sl GROUP BY ALL)"


@query("scored_multilabel", _THR + _area_sql("mi", "") + " SELECT round(aucpr, 6) AS aucpr FROM ar")
def aucpr(spark, d):
    return rounded(T.area_pr(T.micro(_multilabel(spark, d))))


for _name, _expr in {"precision": "tp/(tp+fp)", "recall": "tp/(tp+fn)", "f1": "2*tp/(2*tp+fp+fn)"}.items():
    query("scored_multilabel", _THR + f" SELECT round({_expr}, 6) AS {_name} FROM mi WHERE i = 100", name=_name)(
        lambda spark, d, n=_name: rounded(T.at_half(T.micro(_multilabel(spark, d))).select(n))
    )


@query("scored_multilabel", _THR + " SELECT round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS matthews FROM ct WHERE i = 100 AND class = 0")
def matthews(spark, d):
    return rounded(T.matthews(_multilabel(spark, d)))


@query("scored_multilabel", _THR + " SELECT round(max(CASE WHEN tp+fp > 0 AND tp/(tp+fp) >= 0.7 THEN tp/(tp+fn) ELSE 0 END), 6) AS recall_at_precision FROM mi")
def recall_at_precision(spark, d):
    return rounded(T.recall_at_precision(T.micro(_multilabel(spark, d)), 0.7))


@query("scored_multilabel", _THR + _area_sql("ct", "class") + " SELECT 'per_class/0' || class || '_' || ['quality','toxic'][class+1] || '_' || m AS metric, round(CASE m WHEN 'f1' THEN 2*tp/(2*tp+fp+fn) WHEN 'prec' THEN tp/(tp+fp) WHEN 'recall' THEN tp/(tp+fn) ELSE aucpr END, 6) AS value FROM ct JOIN ar USING (class), (SELECT unnest(['f1','prec','recall','auprc']) AS m) WHERE i = 100")
def per_class_multilabel(spark, d):
    counts = _multilabel(spark, d)
    at = T.at_half(counts).join(T.area_pr(counts, ["class"]), "class")
    title = F.get(F.array(F.lit("per_class/00_quality_"), F.lit("per_class/01_toxic_")), F.col("class"))
    rows = [F.struct(F.concat(title, F.lit(m)).alias("metric"), F.col(c).alias("value")) for m, c in (("f1", "f1"), ("prec", "precision"), ("recall", "recall"), ("auprc", "aucpr"))]
    return rounded(at.select(F.inline(F.array(*rows))))


# Exact curves
_CURVE = ", g AS (SELECT score, sum(weight*label) AS p, sum(weight*(1-label)) AS n FROM scored_bin GROUP BY ALL), cv AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM g WINDOW w AS (ORDER BY score DESC))"


@query("scored_bin", _CURVE + " SELECT round(sum((CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END + CASE WHEN tp-p+fp-n > 0 THEN (tp-p)/(tp-p+fp-n) ELSE 1 END)/2*p/all_p), 6) AS exact_aucpr FROM cv")
def exact_aucpr(spark, d):
    return rounded(T.exact_aucpr(X.scored_bin(spark, d), weight=F.col("weight")))


@query("scored_bin", _CURVE + " SELECT round(coalesce(arg_min(tp/all_p, score) FILTER (tp+fp > 0 AND tp/(tp+fp) >= 0.5), 0), 6) AS exact_recall_at_precision FROM cv")
def exact_recall_at_precision(spark, d):
    return rounded(T.exact_recall_at_precision(X.scored_bin(spark, d), 0.5, weight=F.col("weight")))


@query("scored_bin", ", g AS (SELECT score, sum(label) AS p, sum(1-label) AS n FROM scored_bin GROUP BY ALL), cv AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM g) SELECT round(sum(n*(tp-p+p/2))/(any_value(all_p)*any_value(all_n)), 6) AS roc_auc FROM cv")
def roc_auc(spark, d):
    return rounded(T.roc_auc(X.scored_bin(spark, d), F.col("score"), F.col("label") == 1, F.col("label").isin(0, 1)))


# Numbers
_REG = {
    "bias": "avg(pred-label)", "mse": "avg((pred-label)*(pred-label))", "rmse": "sqrt(avg((pred-label)*(pred-label)))", "mae": "avg(abs(pred-label))",
    "smape": "avg(abs(pred-label)/((abs(pred)+abs(label))/2+1e-8))",
}
for _name, _expr in _REG.items():
    query("scored_reg", f"SELECT round({_expr}, 6) AS {_name} FROM scored_reg WHERE weight > 0", name=_name)(
        lambda spark, d, n=_name: rounded(R.regression_metrics(X.scored_reg(spark, d), keep=F.col("weight") > 0).select(n))
    )


@query("scored_reg", "SELECT round(1 - sum(weight*(label-pred)*(label-pred)) / (sum(weight*label*label) - sum(weight*label)*sum(weight*label)/sum(weight)), 6) AS r2 FROM scored_reg")
def r2(spark, d):
    return rounded(R.r2(X.scored_reg(spark, d), weight=F.col("weight")))


@query("scored_reg", "SELECT round(corr(pred, label), 6) AS pearson FROM scored_reg WHERE weight > 0")
def pearson(spark, d):
    return rounded(R.pearson(X.scored_reg(spark, d), keep=F.col("weight") > 0))


@query("scored_px", ", e AS (SELECT id, avg((label = 1)::INT) AS a, avg(1/(1+exp(logits[1]-logits[2]))) AS b FROM scored_px WHERE label IN (0, 1) AND weight > 0 GROUP BY id) SELECT round(corr(a, b), 6) AS example_pearson FROM e")
def example_pearson(spark, d):
    df = X.scored_px(spark, d)
    prob = F.get(softmax(F.slice("logits", 1, 2)), F.lit(1))
    return rounded(R.example_pearson(df, "id", F.col("label") == 1, prob, F.col("label").isin(0, 1) & (F.col("weight") > 0)))


@query("scored_reg", ", r AS (SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1)/2 AS a, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1)/2 AS b FROM scored_reg) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return rounded(R.spearman(X.scored_reg(spark, d)))


_K1, _K2 = [0.0, 10.0, 25.0, 40.0], [0.0, 0.03, 0.06, 0.2]
_BINNED = ", b AS (SELECT pred, label, abs(pred-label) AS a, (key1 >= 10)::INT + (key1 >= 25)::INT AS k1, (key2 >= 0.03)::INT + (key2 >= 0.06)::INT AS k2 FROM scored_reg WHERE weight > 0 AND key1 >= 0 AND key1 < 40 AND key2 >= 0 AND key2 < 0.2)"
_STRAT = {"mae": "avg(a)", "mse": "avg(a*a)", "rmse": "sqrt(avg(a*a))", "smape": "avg(2*a/(abs(label)+abs(pred)+1e-8))", "pearson": "corr(pred, label)"}
for _name, _expr in _STRAT.items():
    query("scored_reg", _BINNED + f" SELECT x.i::INT AS key1_bin, y.i::INT AS key2_bin, count(a) AS n, round(coalesce({_expr}, {'0' if _name != 'pearson' else chr(39) + 'nan' + chr(39) + '::DOUBLE'}), 6) AS value FROM range(3) x(i) CROSS JOIN range(3) y(i) LEFT JOIN b ON k1 = x.i AND k2 = y.i GROUP BY ALL", name=f"stratified_{_name}")(
        lambda spark, d, n=_name: rounded(R.stratified(X.scored_reg(spark, d), n, {"key1": _K1, "key2": _K2}, keep=F.col("weight") > 0))
    )


@query("scored_cls", f", p AS (SELECT list_max({_SOFTMAX}) AS conf, ({_ARG} = label)::INT AS ok, mask FROM scored_cls), b AS (SELECT (SELECT count(*) FROM range(15) r(i) WHERE conf >= i/14.0::DOUBLE) AS bin, ok-conf AS gap, mask FROM p), s AS (SELECT bin, sum(CASE WHEN mask THEN gap ELSE 0 END) AS gap, count(*) AS n FROM b GROUP BY bin) SELECT round(sum(CASE WHEN bin < 15 THEN abs(gap) ELSE 0 END)/sum(n), 6) AS ece FROM s")
def ece(spark, d):
    df = X.scored_cls(spark, d).withColumn("probs", softmax(F.col("logits")))
    return rounded(R.ece(df, "probs", keep=F.col("mask")))


for _name, _f in {"min_logvar": "min", "max_logvar": "max"}.items():
    query("scored_reg", f"SELECT round({_f}(ln(label)) FILTER (weight > 0), 6) AS {_name} FROM scored_reg", name=_name)(
        lambda spark, d, n=_name: rounded(R.log_variance_range(X.scored_reg(spark, d), F.log("label"), F.col("weight")).select(n))
    )


@query("scored_cls", "SELECT count(*) FILTER (mask) AS mask_count FROM scored_cls")
def mask_count(spark, d):
    return X.scored_cls(spark, d).agg(F.count(F.when(F.col("mask"), 1)).alias("mask_count"))


for _name, (_f, _expr) in {
    "loss_mean": (lambda: F.avg("value"), "avg(value)"), "loss_std": (lambda: F.stddev_pop("value"), "stddev_pop(value)"),
    "last_value": (lambda: F.max_by("value", "step"), "arg_max(value, step)"),
}.items():
    query("metric_log", f"SELECT run, metric, round({_expr}, 6) AS {_name} FROM metric_log GROUP BY ALL", name=_name)(
        lambda spark, d, n=_name, f=_f: rounded(X.metric_log(spark, d).groupBy("run", "metric").agg(f().alias(n)))
    )


@query("scored_cls", f", p AS (SELECT {_ARG} AS pred, label AS true FROM scored_cls) SELECT pred::INT AS pred, \"true\", count(*) AS n FROM p GROUP BY ALL")
def merge_states(spark, d):
    """Partial counts by part of the data, summed later."""
    df = X.scored_cls(spark, d).select((F.col("id") % 4).alias("part"), argmax(F.col("logits")).alias("pred"), F.col("label").alias("true"))
    states = df.groupBy("part", "pred", "true").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy("pred", "true").agg(F.sum("n").alias("n"))


