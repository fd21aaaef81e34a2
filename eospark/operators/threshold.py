"""Metrics over a grid of thresholds, and exact ones over all distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.arrays import div0, div_nan
from eospark.operators.global_order import global_cumsum

#: 200 thresholds from just below 0 to just above 1.
GRID = [-1e-7, *[i / 199 for i in range(1, 199)], 1 + 1e-7]
#: "At 0.5" is the first threshold that is not below it.
AT_HALF = 100


def exploded(df: DataFrame, labels: str = "labels", predictions: str = "predictions", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row an example and class: class, label, pred."""
    zipped = F.arrays_zip(F.col(labels).alias("label"), F.col(predictions).alias("pred"))
    rows = df.select(*keep, F.posexplode(zipped).alias("class", "z"))
    return rows.select(*keep, "class", F.col("z.label").alias("label"), F.col("z.pred").cast("double").alias("pred"))


def above(score: Column, grid: list[float] = GRID) -> Column:
    """How many of the evenly spaced thresholds are below the score; NaN is above none.

    A guess by arithmetic is set right by comparing with the thresholds themselves.
    """
    n = len(grid)
    at = F.array(*[F.lit(x) for x in grid])
    guess = F.least(F.greatest(F.ceil(score * (n - 1)).cast("int"), F.lit(0)), F.lit(n))
    more = F.when((guess < n) & (F.get(at, guess) < score), 1).otherwise(0)
    fewer = F.when((guess > 0) & (F.get(at, guess - 1) >= score), 1).otherwise(0)
    return F.when(F.isnan(score), 0).otherwise(guess + more - fewer)


def counts_by_threshold(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """``class, i, tp, fp, fn, tn`` of long rows (class, label, pred) at each threshold; labels other than 0 and 1 count nowhere.

    Rows are first summed by class and bucket, so there is no row for each threshold.
    """
    weight = F.lit(1.0) if weight is None else weight
    rows = rows.select("class", above(F.col("pred")).alias("b"), F.when(F.col("label") == 1, weight).otherwise(0.0).alias("p"), F.when(F.col("label") == 0, weight).otherwise(0.0).alias("n"))
    sums = rows.groupBy("class", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    buckets = F.array_sort(F.collect_list(F.struct("b", "p", "n")))  # at most one more than thresholds
    by_class = sums.groupBy("class").agg(buckets.alias("s"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    rows = by_class.select("class", "s", "all_p", "all_n", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("i"))
    over = lambda c: F.aggregate(F.filter("s", lambda x: x["b"] > F.col("i")), F.lit(0.0), lambda a, x: a + x[c])
    rows = rows.select("class", "i", over("p").alias("tp"), over("n").alias("fp"), "all_p", "all_n")
    return rows.select("class", "i", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"))


def micro(counts: DataFrame) -> DataFrame:
    return counts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def area_pr(counts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Interpolated area under the precision-recall curve, from counts by threshold."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("i")  # one row a threshold
    nxt = lambda c: F.lead(c).over(w)
    rows = counts.select(*keys, "i", "tp", (F.col("tp") + F.col("fp")).alias("p"), nxt("tp").alias("tp2"), (nxt("tp") + nxt("fp")).alias("p2"), nxt("fn").alias("fn2"))
    rows = rows.where("tp2 is not null")
    dtp = F.col("tp") - F.col("tp2")
    slope = div0(dtp, F.greatest(F.col("p") - F.col("p2"), F.lit(0.0)))
    cut = F.col("tp2") - slope * F.col("p2")
    ratio = F.when((F.col("p") > 0) & (F.col("p2") > 0), F.try_divide(F.col("p"), F.col("p2"))).otherwise(1.0)
    part = div0(slope * (dtp + cut * F.log(ratio)), F.col("tp2") + F.col("fn2"))
    return rows.groupBy(*keys).agg(F.sum(part).alias("aucpr"))


def at_half(counts: DataFrame, index: int = AT_HALF) -> DataFrame:
    """``keys.., precision, recall, f1``, 0 / 0 being 0, at one threshold."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    others = [c for c in counts.columns if c == "class"]
    return counts.where(F.col("i") == index).select(
        *others, div0(tp, tp + fp).alias("precision"), div0(tp, tp + fn).alias("recall"), div0(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def matthews(counts: DataFrame) -> DataFrame:
    """Matthews correlation of class 0 at the threshold of 0.5; 0 if a margin is empty."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    value = div0(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.where((F.col("i") == AT_HALF) & (F.col("class") == 0)).select(value.alias("matthews"))


def recall_at_precision(counts: DataFrame, point: float) -> DataFrame:
    """The largest recall over the thresholds whose precision is at least ``point``; 0 if there is none."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    best = F.max(F.when(div0(tp, tp + fp) >= point, div0(tp, tp + fn)))
    return counts.agg(F.coalesce(best, F.lit(0.0)).alias("recall_at_precision"))


def _curve(df: DataFrame, score: Column, positive: Column, weight: Column) -> DataFrame:
    """``score, p, n, tp, fp``: weights by distinct score, and their running sums from the highest score down."""
    sums = df.select(score.alias("score"), F.when(positive, weight).otherwise(0.0).alias("p"), F.when(positive, 0.0).otherwise(weight).alias("n"))
    sums = sums.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return global_cumsum(sums, [F.col("score").desc()], {"tp": "p", "fp": "n"})


def exact_aucpr(df: DataFrame, score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Area under the exact weighted precision-recall curve: trapezoids between distinct scores, from recall 0 at precision 1."""
    weight = F.lit(1.0) if weight is None else weight
    c = _curve(df, F.col(score), F.col(label) == 1, weight)
    total = c.agg(F.max("tp").alias("all"))
    # The point before a score follows from the score's own sums.
    before_tp, before_fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    prec = lambda t, f, empty: F.when(t + f > 0, F.try_divide(t, t + f)).otherwise(empty)
    start = F.when(before_tp + before_fp > 0, prec(before_tp, before_fp, 0.0)).otherwise(1.0)
    part = (prec(F.col("tp"), F.col("fp"), 0.0) + start) / 2 * div_nan(F.col("p"), F.col("all"))
    return c.join(F.broadcast(total)).agg(F.sum(part).alias("exact_aucpr"))


def exact_recall_at_precision(df: DataFrame, point: float, score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Recall at the lowest score whose precision is at least ``point``; 0 if no score's is."""
    weight = F.lit(1.0) if weight is None else weight
    c = _curve(df, F.col(score), F.col(label) == 1, weight)
    ok = F.when(div0(F.col("tp"), F.col("tp") + F.col("fp")) >= point, F.col("score"))
    return c.agg(F.coalesce(div_nan(F.min_by("tp", ok), F.max("tp")), F.lit(0.0)).alias("exact_recall_at_precision"))


def roc_auc(df: DataFrame, score: Column, positive: Column, keep: Column | None = None) -> DataFrame:
    """Rank AUC over all rows; ties count half. NaN if there is only one kind of rows."""
    c = _curve(df.where(keep) if keep is not None else df, score, positive, F.lit(1.0))
    # Negatives of the same score count half, those of lower scores are what is left.
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    return c.agg(div_nan(wins, F.max("tp") * F.max("fp")).alias("roc_auc"))


