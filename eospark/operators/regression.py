"""Metrics of numbers: sums over rows, then arithmetic on one row. A row counts where ``keep`` is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.arrays import NAN, argmax, digitize, div_nan
from eospark.functions.storage import staged


def smape(p: Column, y: Column, eps: float = 1e-8) -> Column:
    return F.abs(p - y) / ((F.abs(p) + F.abs(y)) / 2 + eps)


def regression_metrics(df: DataFrame, pred: str = "pred", label: str = "label", keys: list[str] = [], keep: Column | None = None) -> DataFrame:  # noqa: B006
    """``bias, mse, rmse, mae, smape`` in one pass."""
    p, y = F.col(pred), F.col(label)
    d = p - y
    rows = df.where(keep) if keep is not None else df
    return rows.groupBy(*keys).agg(
        F.avg(d).alias("bias"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(smape(p, y)).alias("smape")
    )


def r2(df: DataFrame, pred: str = "pred", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Weighted R2; NaN below two units of weight."""
    weight = F.lit(1.0) if weight is None else weight
    p, y = F.col(pred), F.col(label)
    s = df.agg(F.sum(weight).alias("n"), F.sum(weight * y).alias("y"), F.sum(weight * y * y).alias("yy"), F.sum(weight * (y - p) * (y - p)).alias("e"))
    spread = F.col("yy") - div_nan(F.col("y") * F.col("y"), F.col("n"))
    return s.select(F.when(F.col("n") < 2, F.lit(NAN)).otherwise(1 - div_nan(F.col("e"), spread)).alias("r2"))


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    spread = (n * xx - x * x) * (n * yy - y * y)
    return F.when(spread > 0, F.try_divide(n * xy - x * y, F.sqrt(spread))).otherwise(F.lit(NAN))


def _sums(x: Column, y: Column) -> list[Column]:
    return [F.count(x).cast("double").alias("n"), *[F.sum(e).alias(a) for a, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))]]


def pearson(df: DataFrame, pred: str = "pred", label: str = "label", keep: Column | None = None) -> DataFrame:
    """Pearson correlation; NaN for two rows or fewer."""
    rows = df.where(keep) if keep is not None else df
    s = rows.agg(*_sums(F.col(pred), F.col(label)))
    value = _correlation(*(F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    return s.select(F.when(F.col("n") <= 2, F.lit(NAN)).otherwise(value).alias("pearson"))


def example_pearson(df: DataFrame, key: str, positive: Column, prob: Column, keep: Column) -> DataFrame:
    """Correlation over examples of the share of true pixels and the mean true probability; examples without pixels drop out."""
    per = df.where(keep).groupBy(key).agg(F.avg(positive.cast("double")).alias("share"), F.avg(prob).alias("mean_prob"))
    return per.agg(F.corr("share", "mean_prob").alias("example_pearson"))


#: Ranges of values at most: sums are kept for each pair of ranges of the two columns.
RANGES = 512


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are less than the value, by bisection."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    # NaN is less than nothing.
    padded = F.array(*[F.lit(c) for c in [*cuts, *[NAN] * (2 * steps[0] - 1 - len(cuts))]])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(padded, at + s - 1) < value, at + s).otherwise(at))


def _ranks(rows: DataFrame, col: str, cuts: list[float]) -> DataFrame:
    """``<col>_value, <col>_range, <col>_rank``: for each distinct value its range and its average rank (from 1) there.

    ``cuts`` part the values into ranges of about equal counts.
    """
    counts = rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("c")).withColumn("range", _range_of(F.col("value"), cuts))
    upto = F.sum("c").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(F.col("value").alias(f"{col}_value"), F.col("range").alias(f"{col}_range"), (upto - (F.col("c") - 1) / 2.0).alias(f"{col}_rank"))


def spearman(df: DataFrame, pred: str = "pred", label: str = "label", keep: Column | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties. Each side is ranked by distinct values, then joined back by value.

    Ranks run within ranges of values. Rows are summed by their two ranges, and what precedes a range is added to these
    few sums. Average ranks have the mean (n + 1) / 2, so that one aggregate centred on it suffices and large ranks lose
    no digits.
    """
    rows = (df.where(keep) if keep is not None else df).select(F.col(pred).cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    # Two columns, written once, as both sides are ranked from them.
    rows = staged(rows.where("p is not null and y is not null"), "values")
    ranges = min(RANGES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(c, shares, 10 * ranges) for c in ("p", "y")]).first()
    both = rows
    for c, cut in zip("py", cuts[1:], strict=True):
        both = both.join(_ranks(rows, c, sorted({v for v in cut or [] if v == v})), F.col(c) == F.col(f"{c}_value")).drop(f"{c}_value")
    rp, ry = F.col("p_rank"), F.col("y_rank")
    sums = {"sp": rp, "sy": ry, "spp": rp * rp, "syy": ry * ry, "spy": rp * ry}
    cells = both.groupBy("p_range", "y_range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(a) for a, e in sums.items()])
    middle = ((cuts[0] or 0) + 1) / 2
    # A row a pair of ranges.
    before = {c: F.coalesce(F.sum("n").over(Window.orderBy(f"{c}_range").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) - middle for c in "py"}
    cells = cells.withColumns({"bp": before["p"], "by": before["y"]})
    total = lambda a, b: F.sum(F.expr(f"n * b{a} * b{b} + b{a} * s{b} + b{b} * s{a} + s{a}{b}"))
    c = cells.agg(total("p", "p").alias("xx"), total("y", "y").alias("yy"), total("p", "y").alias("xy"))
    return c.select(div_nan(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))


def stratified(df: DataFrame, metric: str, bins: dict[str, list[float]], pred: str = "pred", label: str = "label", keep: Column | None = None) -> DataFrame:
    """``<key>_bin.., n, value`` for ``mae, mse, rmse, smape`` or ``pearson`` on the full grid of half-open bins.

    Rows outside all bins are left out. Empty bins have value 0, or NaN for correlations; these are NaN everywhere if
    there are two rows in all or fewer.
    """
    p, y = F.col(pred), F.col(label)
    rows = df.where(keep) if keep is not None else df
    names = [f"{k}_bin" for k in bins]
    for k, e in bins.items():
        rows = rows.where((F.col(k) >= e[0]) & (F.col(k) < e[-1])).withColumn(f"{k}_bin", digitize(F.col(k), e[1:]).cast("int"))
    d = p - y
    each = {"mae": F.abs(d), "mse": d * d, "rmse": d * d, "smape": 2 * F.abs(d) / (F.abs(y) + F.abs(p) + 1e-8)}
    grid = df.sparkSession.range(1).select()
    for k, e in bins.items():
        grid = grid.withColumn(f"{k}_bin", F.explode(F.sequence(F.lit(0), F.lit(len(e) - 2))))
    if metric == "pearson":
        sums = rows.groupBy(*names).agg(*_sums(p, y))
        out = grid.join(sums, names, "left").withColumn("all", F.expr("sum(n) over ()"))  # one row a bin
        value = _correlation(*(F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
        value = F.when((F.col("all") <= 2) | F.col("n").isNull(), F.lit(NAN)).otherwise(value)
        return out.select(*names, F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"), value.alias("value"))
    sums = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg(each[metric]).alias("value"))
    value = F.coalesce("value", F.lit(0.0))
    value = F.sqrt(value) if metric == "rmse" else value
    return grid.join(sums, names, "left").select(*names, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), value.alias("value"))


def ece(df: DataFrame, probs: str, label: str = "label", keep: Column | None = None, bins: int = 15) -> DataFrame:
    """Expected calibration error over ``bins`` - 1 equal intervals; a confidence of exactly 1 is never summed. Masked rows
    count in the divisor."""
    conf = F.array_max(probs)
    right = (argmax(F.col(probs)) == F.col(label)).cast("double")
    at = digitize(conf, [i / (bins - 1) for i in range(bins)])
    kept = keep.cast("double") if keep is not None else F.lit(1.0)
    sums = df.groupBy(at.alias("bin")).agg(F.sum(kept * (right - conf)).alias("gap"), F.count(F.lit(1)).alias("n"))
    return sums.agg((F.sum(F.when(F.col("bin") < bins, F.abs("gap")).otherwise(0.0)) / F.sum("n")).alias("ece"))


def log_variance_range(df: DataFrame, value: Column, weight: Column) -> DataFrame:
    """``min_logvar, max_logvar`` over rows of positive weight; infinite if there are none."""
    v = F.when(weight > 0, value)
    inf = F.lit(float("inf"))
    return df.agg(F.coalesce(F.min(v), inf).alias("min_logvar"), F.coalesce(F.max(v), -inf).alias("max_logvar"))


def confusion_by_bins(df: DataFrame, edges: list[float], pred: str = "pred", label: str = "label", keep: Column | None = None) -> DataFrame:
    """Confusion counts of binned numbers: a class for each edge; below the first edge is class 0."""
    from eospark.operators.confusion import counted

    at = lambda c: F.greatest(digitize(F.col(c), edges) - 1, F.lit(0)).cast("int")
    return counted(df, at(pred), at(label), len(edges), keep=keep)
