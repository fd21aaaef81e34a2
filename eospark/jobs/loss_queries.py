"""Registered queries: losses as scoring jobs, and inference products."""

from __future__ import annotations

from pyspark.sql import functions as F

from eospark.functions.arrays import one_hot, sigmoid, softmax
from eospark.jobs.registry import query, rounded
from eospark.operators import losses as L
from eospark.operators import products as P
from eospark.sources import fixtures as X

_LSE = "ln(list_sum(list_transform(logits, lambda v: exp(v))))"
_PROB = "list_transform(logits, lambda z: exp(z) / list_sum(list_transform(logits, lambda v: exp(v))))"
_CLS = {
    "softmax_xent": (lambda z, y: L.softmax_xent(z, y), f"{_LSE} - logits[label+1]"),
    "lq_loss": (lambda z, y: L.lq_loss(z, y), f"(1 - pow(({_PROB})[label+1] + 1e-7, 0.7)) / 0.7"),
    "sigmoid_xent": (lambda z, y: L.sigmoid_xent(z, y), "(list_sum(list_transform(logits, lambda v: ln(1+exp(v)))) - logits[label+1]) / 10"),
    "softmax_focal": (lambda z, y: L.softmax_focal(z, y), f"-0.25*(logits[label+1]-{_LSE}) * pow(1 - exp(0.25*(logits[label+1]-{_LSE})), 2)"),
}
for _name, (_f, _sql) in _CLS.items():
    query("scored_cls", f"SELECT id, round({_sql}, 6) AS loss FROM scored_cls", name=_name)(
        lambda spark, d, f=_f: rounded(X.scored_cls(spark, d).select("id", f(F.col("logits"), one_hot(F.col("label"), 10)).alias("loss")))
    )


@query("scored_cls", f", a AS (SELECT *, list_filter(list_transform(range(1, 11), lambda i: CASE WHEN i-1 IN (label, (label+1)%10) THEN logits[i] END), lambda v: v IS NOT NULL) AS kept, {_PROB} AS p FROM scored_cls) SELECT id, round({_LSE} - ln(list_sum(list_transform(kept, lambda v: exp(v)))) - 0.1*list_sum(list_transform(p, lambda v: v*ln(v))), 6) AS loss FROM a")
def partial_label_loss(spark, d):
    df = X.scored_cls(spark, d)
    allowed = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i.isin(F.col("label"), (F.col("label") + 1) % 10), 1).otherwise(0))
    return rounded(df.select("id", L.partial_label_loss(F.col("logits"), allowed).alias("loss")))


@query("scored_cls", f", a AS (SELECT id, label, list_transform(logits, lambda v: 1/(1+exp(-v))) AS p FROM scored_cls) SELECT id, round(-ln(p[label+1]), 6) AS loss FROM a")
def kld_loss(spark, d):
    df = X.scored_cls(spark, d)
    return rounded(df.select("id", L.kld_loss(F.col("logits"), one_hot(F.col("label"), 10)).alias("loss")))


@query("scored_px", f", p AS (SELECT id, weight, {_LSE} - list_sum(list_transform(range(1, 5), lambda i: logits[i] * CASE WHEN i-1 = label THEN 0.9 ELSE 0.1/3 END)) AS l FROM scored_px) SELECT id, round(CASE WHEN sum(weight) > 0 THEN sum(l*weight)/sum(weight) ELSE 0 END, 6) AS loss FROM p GROUP BY id")
def generalized_softmax_xent(spark, d):
    loss = L.softmax_xent(F.col("logits"), one_hot(F.col("label"), 4, 0.1))
    return rounded(L.weighted_mean(X.scored_px(spark, d), "id", loss, F.col("weight")))


_DICE = {"standard": "sp+sy", "squared": "pp+sy", "tanimoto": "2*(pp+sy-i)", "tversky": "2*(0.3*pp+0.7*sy)"}
_NORM = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DICE.items())


@query("scored_px", f", p AS (SELECT id, k.c, ({_PROB})[k.c+1] AS p, (label = k.c)::INT AS y FROM scored_px, range(4) k(c) WHERE weight > 0), s AS (SELECT id, c, n.n, sum(p*y) AS i, sum(p) AS sp, sum(y) AS sy, sum(p*p) AS pp FROM p, (SELECT unnest(['standard','squared','tanimoto','tversky']) AS n) n GROUP BY ALL) SELECT id, n AS norm_type, round(1 - avg((2*i+1e-3)/(CASE n {_NORM} END + 1e-3)), 6) AS loss FROM s GROUP BY ALL")
def generalized_dice(spark, d):
    df = X.scored_px(spark, d)
    out = None
    for norm in _DICE:
        one = L.generalized_dice(df, "id", softmax(F.col("logits")), one_hot(F.col("label"), 4), F.col("weight"), norm_type=norm)
        one = one.select("id", F.lit(norm).alias("norm_type"), "loss")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_NUM = {
    "l2_loss": (L.l2_loss, "(pred-label)*(pred-label)"), "l1_loss": (L.l1_loss, "abs(pred-label)"),
    "huber_loss": (L.huber_loss, "CASE WHEN abs(pred-label) <= 1 THEN 0.5*(pred-label)*(pred-label) ELSE abs(pred-label)-0.5 END"),
    "smape_loss": (L.smape_loss, "abs(pred-label)/((abs(pred)+abs(label))/2+1e-8)"),
    "gnll_loss": (lambda p, y: L.gnll_loss(p, y, F.col("key2")), "((pred-label)*(pred-label)/(exp(key2)+1e-8)+key2)/2"),
}
for _name, (_f, _sql) in _NUM.items():
    query("scored_reg", f"SELECT key1, round(sum(({_sql})*weight)/sum(weight), 6) AS loss FROM scored_reg GROUP BY key1", name=_name)(
        lambda spark, d, f=_f: rounded(L.weighted_mean(X.scored_reg(spark, d), "key1", f(F.col("pred"), F.col("label")), F.col("weight")))
    )


@query("scored_cls", f", a AS (SELECT id, {_LSE} - logits[label+1] AS x, (1 - pow(({_PROB})[label+1] + 1e-7, 0.7)) / 0.7 AS q FROM scored_cls) SELECT id, round((2*x+q)/3, 6) AS loss, round(x, 6) AS xent, round(q, 6) AS lq FROM a")
def weighted_losses_sum(spark, d):
    z, y = F.col("logits"), one_hot(F.col("label"), 10)
    parts = {"xent": (L.softmax_xent(z, y), 2.0), "lq": (L.lq_loss(z, y), 1.0)}
    return rounded(X.scored_cls(spark, d).select("id", *L.weighted_losses_sum(parts)))


@query("scored_cls", f", a AS (SELECT id, {_LSE} - logits[label+1] AS x, (list_position(logits, list_max(logits))-1 = label)::INT AS ok, {_LSE} - logits[strata+1] AS x2, (list_position(logits, list_max(logits))-1 = strata)::INT AS ok2 FROM scored_cls) SELECT round(avg(x)+avg(x2), 6) AS loss, round((avg(ok)+avg(ok2))/2, 6) AS acc, round(avg(x), 6) AS loss_label, round(avg(x2), 6) AS loss_strata FROM a")
def multitask_sum(spark, d):
    return rounded(P.multitask(X.scored_cls(spark, d), {"label": 10, "strata": 10}))


@query("pairs", ", s AS (SELECT a.batch_id, a.pair, a.view, sum(exp(list_dot_product(a.v, b.v))) AS z, max(CASE WHEN b.pair = a.pair THEN list_dot_product(a.v, b.v) END) AS pos FROM pairs a JOIN pairs b ON a.batch_id = b.batch_id AND NOT (a.pair = b.pair AND a.view = b.view) GROUP BY ALL) SELECT batch_id, pair, round(sum(ln(z) - pos), 6) AS loss FROM s GROUP BY ALL HAVING count(*) = 2")
def nt_xent(spark, d):
    return rounded(L.nt_xent(X.pairs(spark, d)))


@query("arrays", ", b AS (SELECT a.id, i.i, j.j, (SELECT list(struct_pack(h := data[(y+i.i)*8+x+j.j+1], s := a.data[(x+2)*8+y+3])) FROM range(4) r(y), range(4) c(x)) AS px FROM arrays a, range(5) i(i), range(5) j(j)), m AS (SELECT id, i, j, px, list_sum(list_transform(px, lambda q: q.h-q.s))/16 AS bias FROM b), l AS (SELECT id, list_sum(list_transform(px, lambda q: abs(q.h-q.s-bias)))/16 AS l1, list_sum(list_transform(px, lambda q: (q.h-q.s-bias)*(q.h-q.s-bias)))/16 AS mse FROM m) SELECT id, round(min(l1), 6) AS l1, round(min(mse), 6) AS sr_mse, round(max(-10*log10(mse)), 6) AS cpsnr FROM l GROUP BY id")
def supres_loss(spark, d):
    """Prediction: the transposed raster; truth: the raster; a border of two pixels."""
    df = X.arrays(spark, d)
    sr = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.get("data", x * 8 + y))))
    return rounded(P.supres_losses(df.select("id", sr.alias("sr"), F.col("data").alias("hr")), 8, border=2))


@query("arrays", ", b AS (SELECT a.id, (SELECT avg(abs(a.data[(y+i.i)*8+x+j.j+1] - a.data[(x+1)*8+y+2])) FROM range(6) r(y), range(6) c(x)) AS l FROM arrays a, range(3) i(i), range(3) j(j)) SELECT id, round(min(l), 6) AS loss FROM b GROUP BY id")
def generalized_supres(spark, d):
    df = X.arrays(spark, d)
    sr = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.get("data", x * 8 + y))))
    return rounded(P.shift_search(df.select("id", sr.alias("sr"), F.col("data").alias("hr")), 8, border=1))


@query("arrays", ", w AS (SELECT id, r.y, c.x, [data[(r.y+i//3)*8+c.x+i%3+1] FOR i IN range(9)] AS p, [data[(c.x+i%3)*8+r.y+i//3+1] FOR i IN range(9)] AS q FROM arrays, range(6) r(y), range(6) c(x)), m AS (SELECT *, list_avg(p) AS mx, list_avg(q) AS my, list_sum(list_transform(p, lambda v: v*v))/9 AS xx, list_sum(list_transform(q, lambda v: v*v))/9 AS yy, list_dot_product(p, q)/9 AS xy FROM w) SELECT id, round(avg(least(greatest((1 - (2*mx*my+0.0001)*(2*(xy-mx*my)+0.0009)/((mx*mx+my*my+0.0001)*(xx-mx*mx+yy-my*my+0.0009)))/2, 0), 1)), 6) AS ssim FROM m GROUP BY id")
def ssim(spark, d):
    df = X.arrays(spark, d)
    other = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.get("data", x * 8 + y))))
    return rounded(P.ssim(df.select("id", F.col("data").alias("a"), other.alias("b")), 8, 8))


# Predictions and inference products
_INT = "list_transform(range(1, 11), lambda i: trunc(250*p[i])::SMALLINT)"


@query("scored_cls", f", a AS (SELECT id, list_position(logits, list_max(logits))-1 AS preds, {_PROB} AS p FROM scored_cls) SELECT id, preds::INT AS preds, {_INT} AS probs FROM a")
def infer_cls(spark, d):
    return P.infer(X.scored_cls(spark, d), ["id"])


@query("scored_px", f", a AS (SELECT id, y, x, list_position(logits, list_max(logits))-1 AS preds, {_PROB} AS p FROM scored_px) SELECT id, y, x, preds::INT AS preds, list_transform(range(2, 5), lambda i: trunc(250*p[i])::SMALLINT) AS probs FROM a")
def infer_seg(spark, d):
    return P.infer(X.scored_px(spark, d), ["id", "y", "x"], exclude_background=True)


@query("scored_px", "SELECT (list_position(logits, list_max(logits))-1)::INT AS class, count(*) AS n FROM scored_px GROUP BY ALL")
def class_area(spark, d):
    return P.class_area(P.prediction_stats(X.scored_px(spark, d), "id"))


_PAN = ", v AS (SELECT id, y, x, list_position(logits, list_max(logits))-1 AS inst, [logits[4], logits[3], logits[2], logits[1]] AS sem FROM scored_px), g AS (SELECT id, inst, count(*) AS n, [sum(sem[1]), sum(sem[2]), sum(sem[3]), sum(sem[4])] AS s FROM v GROUP BY ALL), k AS (SELECT id, inst, list_position(s, list_max(s))-1 AS cls, n/16.0 > 0.25 AS ok FROM g)"


@query("scored_px", _PAN + " SELECT id, y, x, (CASE WHEN ok THEN inst ELSE 0 END)::INT AS instance, cls::INT AS class FROM v JOIN k USING (id, inst)")
def panoptic_post(spark, d):
    df = X.rasters_of(X.table(spark, d, "embeddings"), 1, 4, 4, 4)
    voted = P.panoptic(F.transform("logits", lambda x: F.reverse(x)), F.col("logits"), min_fraction=0.25)
    rows = df.select("id", voted.alias("v")).select("id", F.posexplode(F.arrays_zip("v.instance", "v.class")).alias("p", "c"))
    return rows.select("id", F.expr("cast(p div 4 as int)").alias("y"), (F.col("p") % 4).alias("x"), F.col("c.instance"), F.col("c.class"))


@query("scored_px", f", a AS (SELECT id, {_LSE} AS z, logits[label+1] AS t, logits[4-label] AS r FROM scored_px) SELECT id, round(avg(z-t), 6) AS semantics_loss, round(avg(z-r), 6) AS instances_loss, round(avg(z-t)+avg(z-r), 6) AS loss FROM a GROUP BY id")
def panoptic_loss(spark, d):
    df = X.scored_px(spark, d)
    y = one_hot(F.col("label"), 4)
    a = F.avg(L.softmax_xent(F.col("logits"), y))
    b = F.avg(L.softmax_xent(F.reverse("logits"), y))
    return rounded(df.groupBy("id").agg(a.alias("semantics_loss"), b.alias("instances_loss"), (a + b).alias("loss")))


@query("scored_cls", f"SELECT id, list_transform({_PROB}, lambda v: round(v, 6)) AS probs FROM scored_cls", name="softmax")
def softmax_job(spark, d):
    return rounded(X.scored_cls(spark, d).select("id", softmax(F.col("logits")).alias("probs")))


@query("scored_cls", "SELECT id, list_transform(logits, lambda v: round(1/(1+exp(-v)), 6)) AS probs FROM scored_cls", name="sigmoid")
def sigmoid_job(spark, d):
    return rounded(X.scored_cls(spark, d).select("id", F.transform("logits", sigmoid).alias("probs")))


@query("scored_cls", "SELECT id, (list_position(logits, list_max(logits))-1)::INT AS pred FROM scored_cls")
def argmax_label(spark, d):
    return P.with_prediction(X.scored_cls(spark, d)).select("id", "pred")


@query("scored_px", "SELECT id, y, x, (label > 0)::INT * weight AS w FROM scored_px")
def eval_weights(spark, d):
    return X.scored_px(spark, d).select("id", "y", "x", P.eval_weights(F.col("label"), exclude_background=True, weight=F.col("weight")).alias("w"))


@query("scored_px", f", p AS (SELECT id, {_PROB} AS p FROM scored_px WHERE label = id%4) SELECT id, [round(sum(p[1]), 6), round(sum(p[2]), 6), round(sum(p[3]), 6), round(sum(p[4]), 6)] AS logits FROM p GROUP BY id")
def seg_to_cls(spark, d):
    df = X.scored_px(spark, d).withColumn("example_label", (F.col("id") % 4).cast("int"))
    return rounded(P.seg_to_cls(df, "id", 4))


@query("scored_cls", f", a AS (SELECT id, CASE WHEN label IN (1, 3) THEN 5 ELSE label END AS label, {_PROB} AS p FROM scored_cls) SELECT id, label, [round(p[i+1] * 0, 6) + CASE i WHEN 3 THEN 0 WHEN 5 THEN round(p[2]+p[4], 6) ELSE 0 END FOR i IN range(10)] AS probs FROM a")
def class_mapping(spark, d):
    df = P.map_labels(X.scored_cls(spark, d), {1: 3, 3: 5})
    return rounded(P.map_predictions(df, {1: 5, 3: 5}, 10).select("id", "label", "probs"))


@query("scored_cls", "SELECT id, list_transform(range(1, 11), lambda i: CASE WHEN i-1 < strata THEN '-inf'::DOUBLE ELSE round(logits[i], 6) END) AS logits FROM scored_cls")
def logits_filter(spark, d):
    df = X.scored_cls(spark, d)
    inf = F.lit(float("-inf"))
    bar = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i < F.col("strata"), inf).otherwise(0.0))
    return rounded(df.select("id", P.filter_logits(F.col("logits"), bar).alias("logits")))


@query("scored_cls", "SELECT id, list_transform(logits[head*3+1:head*3+3], lambda v: round(v, 6)) AS logits FROM scored_cls")
def select_head(spark, d):
    df = X.scored_cls(spark, d)
    heads = F.array(*[F.slice("logits", 3 * h + 1, 3) for h in range(3)])
    return rounded(df.select("id", P.select_head(heads, F.col("head")).alias("logits")))


