"""Reports of named metrics, and suites of reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import argmax, log_sum_exp

#: Named metrics of scored classes that one pass can give: (mean of a column, or another aggregate).
ALIASES = {"acc": "accuracy", "loss": "softmax_xent", "xent": "softmax_xent"}
CUSTOM: dict[str, Column] = {}


def _simple(name: str) -> Column:
    hit = (argmax(F.col("logits")) == F.col("label")).cast("int")
    table = {
        "accuracy": lambda: F.avg(hit),
        "softmax_xent": lambda: F.avg(log_sum_exp(F.col("logits")) - F.get("logits", F.col("label"))),
        "mask_count": lambda: F.count(F.lit(1)).cast("double"),
    }
    key = ALIASES.get(name, name)
    if key in table:
        return table[key]()
    if name == "learning_rate":
        return F.max_by(name, "step")
    if name.endswith("_std"):
        return F.stddev_pop(name.removesuffix("_std"))
    return F.avg(name.removesuffix("_avg"))


def safe_name(name: str) -> str:
    """Names of metrics without dots and at signs."""
    return re.sub(r"[.@]", "_", name)


def report(df: DataFrame, metrics: list[str], custom: dict[str, Column] | None = None, mask: str | None = "mask") -> DataFrame:
    """``metric, value`` of all named metrics in one pass over the unmasked rows.

    Names stand for metrics or their aliases; ``x_std`` is a deviation, ``x_avg`` and any other name the mean of a column,
    ``learning_rate`` its last value. ``custom`` adds aggregates by name.
    """
    rows = df.where(F.col(mask)) if mask and mask in df.columns else df
    custom = custom or {}
    values = [F.struct(F.lit(safe_name(m)).alias("metric"), (custom[m] if m in custom else _simple(m)).cast("double").alias("value")) for m in metrics]
    return rows.agg(F.array(*values).alias("r")).select(F.inline("r"))


def suite(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Reports of several evaluators over one table; metric names get the evaluator's name before them.

    A spec has ``metrics`` and may have a ``filter``, which masks rows and removes none.
    """
    out = None
    for name, spec in specs.items():
        rows = df.withColumn("mask", F.col("mask") & spec["filter"]) if "filter" in spec else df
        one = report(rows, spec["metrics"]).withColumn("metric", F.concat(F.lit(f"{name}/"), "metric"))
        out = one if out is None else out.unionByName(one)
    return out
