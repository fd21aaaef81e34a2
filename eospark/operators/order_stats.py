"""Exact order statistics of groups of any size: a quantile sketch brackets each rank, only values inside are counted and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.operators.global_order import global_cumsum

#: Relative accuracy of the sketch: a bracket holds about 4/ACCURACY of a group's rows, so what is ordered is that much smaller.
ACCURACY = 1000
#: Up to so many distinct values in all brackets a window orders them, beyond it ranges over the whole cluster do.
WINDOW_ROWS = 1 << 20


def quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float], window_rows: int = WINDOW_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """``keys, n, q``: the count of values that are not null, and an array of their exact quantiles with linear interpolation.

    ``keys`` has few values (bands, columns): the brackets, one row a key, are broadcast. Every row adds to a count before,
    inside or after the bracket of each quantile, summed before the shuffle; no reducer holds a group. A sketch's error has
    a bound, of which brackets are twice as wide; should a rank fall outside nevertheless, the query fails. A group without
    values has no row; NaN is the largest value.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_v")).where("_v is not null")
    inf, slack = float("inf"), 2.0 / accuracy
    ends = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("_e"), F.count("_v").alias("_m"))
    few = F.col("_m") < 4 * accuracy  # neighbouring ranks are far apart: the bracket holds all
    brackets = [
        F.struct(
            F.lit(j).alias("j"),
            F.when(few | F.lit(p <= slack), F.lit(-inf)).otherwise(F.col("_e")[2 * j]).alias("lo"),
            F.when(few | F.lit(p >= 1 - slack), F.lit(float("nan"))).otherwise(F.col("_e")[2 * j + 1]).alias("hi"),
        )
        for j, p in enumerate(probs)
    ]
    sketch = F.broadcast(sketch.select(*keys, F.array(*brackets).alias("_b")))  # one row a key
    each = (rows.join(sketch, keys) if keys else rows.join(sketch)).select(*keys, "_v", F.explode("_b").alias("_b"))
    part = F.when(F.col("_v") < F.col("_b.lo"), 0).when(F.col("_v") <= F.col("_b.hi"), 1).otherwise(2)
    each = each.select(*keys, F.col("_b.j").alias("_j"), part.alias("_part_of"), "_v")
    each = each.withColumn("_v", F.when(F.col("_part_of") == 1, F.col("_v")))
    counts = staged(each.groupBy(*keys, "_j", "_part_of", "_v").agg(F.count(F.lit(1)).alias("_c")), "counts")
    group = [*keys, "_j"]
    if counts.count() <= window_rows:
        by = Window.partitionBy(*group)
        upto = F.sum("_c").over(by.orderBy("_part_of", "_v").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumns({"_upto": upto, "n": F.sum("_c").over(by)})
    else:
        counts = global_cumsum(counts, [F.col(c) for c in (*group, "_part_of", "_v")], {"_through": "_c"})
        base = counts.groupBy(*group).agg(F.min(F.col("_through") - F.col("_c")).alias("_base"), F.sum("_c").alias("n"))
        counts = counts.join(F.broadcast(base), group).withColumn("_upto", F.col("_through") - F.col("_base"))  # a row a key and quantile
    at = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_j"))
    counts = counts.withColumn("_r", at * (F.col("n") - 1))
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_part_of", "_v")))
    picked = counts.groupBy(*group, "n", "_r").agg(first(F.floor("_r")).alias("_a"), first(F.ceil("_r")).alias("_z"))
    ok = (F.col("_a._part_of") == 1) & (F.col("_z._part_of") == 1)
    a, z, share = F.col("_a._v"), F.col("_z._v"), F.col("_r") - F.floor("_r")
    exact = F.when(ok, F.when(share == 0, a).otherwise(a + (z - a) * share)).otherwise(F.raise_error(F.lit("a rank outside of its bracket")))
    picked = picked.select(*keys, "n", F.struct("_j", exact.alias("v")).alias("q"))
    out = picked.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: x["v"]).alias("q"))  # as long as probs
    return staged(out, "quantiles")
