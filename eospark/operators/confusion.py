"""Confusion counts and what follows from them. Rows are predictions, columns truth; counts are BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.arrays import NAN, argmax, div0, div_nan


def counted(df: DataFrame, pred: Column, true: Column, classes: int, keys: list[str] = [], keep: Column | None = None) -> DataFrame:  # noqa: B006
    """``keys, pred, true, n`` over the full grid of classes; only rows where ``keep`` is true count.

    Rows are summed before the shuffle, so a frequent class does no harm. Labels outside the classes count nowhere.
    """
    rows = df.where(keep) if keep is not None else df
    counts = rows.groupBy(*keys, pred.alias("pred"), true.alias("true")).agg(F.count(F.lit(1)).alias("n"))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = grid.withColumn("pred", F.explode(every)).withColumn("true", F.explode(every))
    return grid.join(counts, [*keys, "pred", "true"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def confusion_matrix(df: DataFrame, classes: int, keys: list[str] = [], label: str = "label", logits: str = "logits", keep: Column | None = None) -> DataFrame:  # noqa: B006
    return counted(df, argmax(F.col(logits)), F.col(label), classes, keys, keep)


def rolling_max_in_row(labels: Column, window: int, pixels: int) -> Column:
    """An array of labels, ``pixels`` a step, with each replaced by the largest in a centred window of an odd number of steps;
    beyond the ends is 0. In the row, so nothing is shuffled."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    steps = F.array(*[F.lit(k * pixels) for k in range(-half, half + 1)])
    return F.transform(labels, lambda x, i: F.array_max(F.transform(steps, lambda k: F.coalesce(F.get(labels, i + k), F.lit(0)))))


def rolling_max(df: DataFrame, window: int, keys: list[str], order: str = "t", label: str = "label") -> DataFrame:
    """Long tables: labels replaced by the largest in a centred window of an odd number of steps; beyond the ends is 0."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    inside = F.max(label).over(w.rowsBetween(-half, half))
    if not half:
        return df
    edge = F.lead(label, half).over(w).isNull() | F.lag(label, half).over(w).isNull()
    return df.withColumn(label, F.when(edge, F.greatest(inside, F.lit(0))).otherwise(inside))


def binary_by_stratum(df: DataFrame, true_classes: list[int], threshold: float, keys: list[str], probs: str, label: str = "label", keep: Column | None = None) -> DataFrame:
    """2 x 2 counts: predicted if the probability of the true classes reaches the threshold."""
    mass = sum((F.get(probs, F.lit(i)) for i in true_classes), F.lit(0.0))
    return counted(df, (mass >= threshold).cast("int"), F.col(label).isin(true_classes).cast("int"), 2, keys, keep)


def _class_sums(cm: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys, class, tp, pred, true, total`` from long counts."""
    diag = F.col("pred") == F.col("true")
    parts = F.array(
        F.struct(F.col("pred").alias("class"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t"), F.when(diag, F.col("n")).otherwise(0).alias("d")),
        F.struct(F.col("true").alias("class"), F.lit(0).cast("bigint").alias("p"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("d")),
    )
    sums = cm.select(*keys, F.inline(parts)).groupBy(*keys, "class").agg(F.sum("d").alias("tp"), F.sum("p").alias("pred"), F.sum("t").alias("true"))
    # One row a class: the window is as small as the matrix's side.
    return sums.withColumn("total", F.sum("true").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))


def macro_metrics(cm: DataFrame, exclude_background: bool = False) -> DataFrame:
    """``miou, f1_macro, precision_macro, recall_macro``: means over classes without those that are 0 / 0."""
    c = _class_sums(cm)
    if exclude_background:
        c = c.where("class <> 0")
    tp, p, t = F.col("tp"), F.col("pred"), F.col("true")
    avg = lambda a, b: F.avg(F.when(b != 0, F.try_divide(a.cast("double"), b)))
    return c.agg(
        avg(tp, p + t - tp).alias("miou"), avg(2 * tp, p + t).alias("f1_macro"), avg(tp, p).alias("precision_macro"), avg(tp, t).alias("recall_macro")
    )


PER_CLASS = ("f1", "prec", "recall", "iou", "acc", "fraction")


def per_class(cm: DataFrame, names: list[str] | None = None, classes: int | None = None, metrics: tuple[str, ...] = ("f1", "prec", "recall"), exclude_unknown: bool = False) -> DataFrame:
    """``metric, value`` named ``per_class/00_name_metric``."""
    names = names or [f"cls{i}" for i in range(classes or 0)]
    if set(metrics) - set(PER_CLASS):
        raise ValueError(f"unknown metrics {set(metrics) - set(PER_CLASS)}")
    tp, p, t, n = (F.col(c) for c in ("tp", "pred", "true", "total"))
    values = {
        "f1": div0(2 * tp, p + t), "prec": div0(tp, p), "recall": div0(tp, t), "iou": div0(tp, p + t - tp),
        "acc": div0(n - p - t + 2 * tp, n), "fraction": div_nan(t, n),
    }
    kept = [i for i, c in enumerate(names) if not (exclude_unknown and (c == "unknown" or c.startswith("_")))]
    title = F.get(F.array(*[F.lit(f"per_class/{i:02}_{c.lower().replace('/', '_')}_") for i, c in enumerate(names)]), F.col("class"))
    rows = F.array(*[F.struct(F.concat(title, F.lit(m)).alias("metric"), values[m].alias("value")) for m in metrics])
    return _class_sums(cm).where(F.col("class").isin(kept)).select(F.inline(rows))


def reduce_classes(cm: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Counts with classes merged; the new classes must be numbered from 0 without gaps."""
    if sorted(set(mapping.values())) != list(range(len(set(mapping.values())))):
        raise ValueError("reduced classes must be 0, 1, ...")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    others = [c for c in cm.columns if c not in ("pred", "true", "n")]
    return cm.groupBy(*others, m[F.col("pred")].alias("pred"), m[F.col("true")].alias("true")).agg(F.sum("n").alias("n"))


def stratified_accuracy(cm: DataFrame, weights: dict[int, float], exclude_background: bool = False) -> DataFrame:
    """``metric, value``: accuracies, areas and standard errors from counts by stratum (``strata, pred, true, n``).

    ``weights`` are the strata's sizes. Strata of weight 0 or without rows are left out of all sums but the total weight.
    """
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    total_w = float(sum(weights.values()))
    # A stratum has one row a class; all sums below run over strata and classes.
    c = _class_sums(cm.withColumn("strata", F.col("strata").cast("int")), ["strata"]).withColumn("w", F.coalesce(w[F.col("strata")], F.lit(0.0)))
    n, tp, p, t, wh = (F.col(x).cast("double") for x in ("total", "tp", "pred", "true", "w"))
    used = (F.col("w") != 0) & (F.col("total") > 0)
    root = lambda x: F.when(x >= 0, F.sqrt(x)).otherwise(F.lit(NAN))
    several = used & (F.col("total") > 1)
    scale = wh * wh * (1 - F.try_divide(n, wh)) / n

    strata = c.groupBy("strata", "w", "total").agg(F.sum("tp").cast("double").alias("tp"))
    y = tp / n
    var = ((1 - y) * (1 - y) * tp + y * y * (n - tp)) / (n - 1)
    overall = strata.agg(
        (F.sum(F.when(used, y * wh)) / total_w).alias("oa"),
        div_nan(F.sum("tp"), F.sum("total")).alias("ns_oa"),
        (root(F.coalesce(F.sum(F.when(several, scale * var)), F.lit(0.0))) / total_w).alias("oa_se"),
    )
    overall = overall.select(F.inline(F.array(*[F.struct(F.lit(f"stratified/{m}").alias("metric"), F.col(m).alias("value")) for m in ("oa", "ns_oa", "oa_se")])))

    sums = lambda x, cond=used: F.sum(F.when(cond, x))
    ratio = c.groupBy("class").agg(
        sums(tp * wh / n).alias("nom"), sums(p * wh / n).alias("ua_den"), sums(t * wh / n).alias("pa_den"),
        (F.sum(F.when(used, wh * t / F.greatest(n, F.lit(1e-10))).otherwise(0.0)) / total_w).alias("area"),
        F.sum("tp").alias("ns_tp"), F.sum("pred").alias("ns_p"), F.sum("true").alias("ns_t"),
    )
    ratio = ratio.withColumn("ua", div_nan(F.col("nom"), F.col("ua_den"))).withColumn("pa", div_nan(F.col("nom"), F.col("pa_den")))
    r = c.join(F.broadcast(ratio), "class")  # one row a class
    cov = lambda a, b, ab: (ab - a * b / n) / (n - 1)
    se = lambda x, q: scale * (cov(tp, tp, tp) + q * q * cov(x, x, x) - 2 * q * cov(tp, x, tp))
    errors = r.groupBy("class").agg(
        *[F.coalesce(sums(e, several), F.lit(0.0)).alias(k) for k, e in (("ua_var", se(p, F.col("ua"))), ("pa_var", se(t, F.col("pa"))), ("area_var", scale * cov(t, t, t)))]
    )
    both = ratio.join(errors, "class")
    f1 = lambda a, b: div_nan(2 * a * b, a + b)
    both = both.withColumn("ns_ua", div_nan(F.col("ns_tp"), F.col("ns_p"))).withColumn("ns_pa", div_nan(F.col("ns_tp"), F.col("ns_t")))
    both = both.withColumn("f1", f1(F.col("ua"), F.col("pa")))
    if exclude_background:
        both = both.where("class <> 0")
    values = {
        "class_{}_ua": F.col("ua"), "class_{}_ua_se": div_nan(root(F.col("ua_var")), F.col("ua_den")),
        "class_{}_pa": F.col("pa"), "class_{}_pa_se": div_nan(root(F.col("pa_var")), F.col("pa_den")), "class_{}_f1": F.col("f1"),
        "ns_class_{}_ua": F.col("ns_ua"), "ns_class_{}_pa": F.col("ns_pa"), "ns_class_{}_f1": f1(F.col("ns_ua"), F.col("ns_pa")),
        "class_{}_area": F.col("area"), "class_{}_area_se": root(F.col("area_var")) / total_w,
    }
    name = lambda k: F.concat(F.lit("stratified/" + k.split("{}")[0]), F.col("class").cast("string"), F.lit(k.split("{}")[1]))
    classes = both.select(F.inline(F.array(*[F.struct(name(k).alias("metric"), v.alias("value")) for k, v in values.items()])))
    # NaN in any class spreads to the mean.
    macro = both.agg(F.avg("f1").alias("value")).select(F.lit("stratified/f1_macro").alias("metric"), "value")
    return overall.unionByName(classes).unionByName(macro)


