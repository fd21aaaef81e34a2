"""Rows in, rows out: splits, mixtures, shuffles, batches, padding, CutMix, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.arrays import u
from eospark.operators.order_stats import quantiles
from eospark.operators.global_order import global_index


def split_rows(df: DataFrame, spec: str, order: list[Column], split: str = "split") -> DataFrame:
    """Rows of a split language: ``a+b`` unites splits, ``a[10:20]`` slices one in the order of ``order``."""
    out = None
    for part in spec.split("+"):
        name, _, cut = part.partition("[")
        rows = df.where(F.col(split) == name)
        if cut:
            lo, colon, hi = cut.rstrip("]").partition(":")
            if not colon:
                raise ValueError(f"no : in slice {part!r}")
            rows = global_index(rows, order, "_i")
            rows = rows.where(F.col("_i") >= int(lo or 0))
            rows = (rows.where(F.col("_i") < int(hi)) if hi else rows).drop("_i")
        out = rows if out is None else out.unionByName(rows)
    return out


def mixture(parts: dict[str, DataFrame], weights: dict[str, float], key: str = "id") -> DataFrame:
    """All datasets with a column ``dataset``; each row is copied floor(w) times, and once more with probability frac(w).

    ``copy`` counts the copies from 0.
    """
    out = None
    for name, df in parts.items():
        w = weights[name]
        whole = math.floor(w)
        copies = F.lit(whole) + (u(F.col(key), f"mix:{name}") < (w - whole)).cast("int")
        rows = df.withColumn("dataset", F.lit(name)).withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
        out = rows if out is None else out.unionByName(rows)
    return out


def mixture_report(mixed: DataFrame) -> DataFrame:
    """``dataset, n, percent``."""
    counts = mixed.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a dataset


def shuffle_key(key: str, seed: int, epoch: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{epoch}")))


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = 0, epoch: int = 0) -> DataFrame:
    """A global shuffle that is the same whenever seed and epoch are; rows are written in the new order."""
    k = shuffle_key(key, seed, epoch)
    return df.repartitionByRange(k).sortWithinPartitions(k)


def batch_rows(df: DataFrame, size: int, order: list[Column], drop_remainder: bool = True) -> DataFrame:
    """``batch_id, batch_pos`` in the order of ``order``; an unfilled last batch is dropped."""
    rows = global_index(df, order, "_i")
    if drop_remainder:
        n = rows.count()
        rows = rows.where(F.col("_i") < n - n % size)
    return rows.withColumn("batch_id", F.expr(f"_i div {size}")).withColumn("batch_pos", (F.col("_i") % size).cast("int")).drop("_i")


def steps(kind: str, amount: float, data_size: int, batch_size: int, total_steps: int | None = None) -> int:
    """A duration in steps, at least 1; ``kind`` is steps, examples, epochs or percent (of ``total_steps``)."""
    if kind == "percent":
        if total_steps is None:
            raise ValueError("percent needs total_steps")
        return max(int(round(amount * total_steps)), 1)
    scale = {"steps": 1, "examples": 1 / batch_size, "epochs": data_size / batch_size}[kind]
    return max(int(amount * scale), 1)


def pad_eval(df: DataFrame, batch_size: int, key: str = "id") -> DataFrame:
    """Whole batches for evaluation: rows of zeros with ``_mask`` false fill the last one. Padding has the ids -1, -2, ..."""
    n = df.count()
    pad = -n % batch_size
    rows = df.withColumn("_mask", F.lit(True))
    empty = df.sparkSession.range(pad).select(
        *[(-1 - F.col("id")).alias(f.name) if f.name == key else _zero(f).alias(f.name) for f in df.schema.fields], F.lit(False).alias("_mask")
    )
    return rows.unionByName(empty)


def _zero(f) -> Column:
    t = f.dataType.simpleString()
    if t.startswith(("array", "map", "struct")):
        return F.lit(None).cast(f.dataType)
    return F.lit("" if t == "string" else False if t == "boolean" else 0).cast(f.dataType)


def subsplit(df: DataFrame, values: list, col: str, mask: str = "_mask") -> DataFrame:
    """Rows of other subsplits stay, but are masked."""
    return df.withColumn(mask, F.col(mask) & F.col(col).isin(values))


def cutmix(df: DataFrame, height: int, width: int, batch: str = "batch_id", key: str = "id", label: str = "label", valid: str = "valid", values: tuple[str, ...] = ("value",), salt: str = "cutmix") -> DataFrame:
    """CutMix of long pixel tables (``batch, key, y, x, label, valid, values..``).

    Rows of a batch get a partner by a random permutation. The box's size is one for the batch (its share is uniform,
    which is the beta distribution with p = 1), its centre is a random valid pixel of the partner. Half sizes are integer
    divisions on both sides. Labels, masks and values inside the box come from the partner where that is valid.
    """
    ids = df.select(batch, key).distinct()
    by = Window.partitionBy(batch)  # a batch is small
    ids = ids.withColumn("_r", F.row_number().over(by.orderBy(key))).withColumn("_s", F.row_number().over(by.orderBy(u(F.col(key), salt), F.col(key))))
    partner = ids.select(batch, key, "_r").join(ids.select(batch, F.col(key).alias("_b"), F.col("_s").alias("_r")), [batch, "_r"]).drop("_r")
    spots = df.where(F.col(valid)).select(F.col(key).alias("_b"), F.col("y").alias("_cy"), F.col("x").alias("_cx"))
    spots = spots.join(partner, "_b")
    pick = F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string"), "_cy", "_cx"))
    centre = spots.groupBy(key).agg(F.min_by(F.struct("_cy", "_cx"), pick).alias("_c"))
    rat = F.sqrt(1.0 - u(F.col(batch), salt + ":lam"))
    boxed = partner.join(centre, key, "left").withColumn("_h", F.floor(height * rat).cast("int")).withColumn("_w", F.floor(width * rat).cast("int"))
    other = df.select(F.col(key).alias("_b"), "y", "x", *[F.col(c).alias(f"_{c}") for c in (label, valid, *values)])
    rows = df.join(boxed, [batch, key]).join(other, ["_b", "y", "x"], "left")
    half = lambda c: F.floor(F.col(c) / 2)
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n))
    inside = F.lit(True)
    for axis, c, s, n in (("y", "_c._cy", "_h", height), ("x", "_c._cx", "_w", width)):
        inside &= (F.col(axis) >= clip(F.col(c) - half(s), n)) & (F.col(axis) < clip(F.col(c) + half(s), n))
    take = F.coalesce(inside & F.col(f"_{valid}"), F.lit(False))
    mixed = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (label, valid, *values)}
    return rows.select(*[mixed.get(c, F.col(c)) for c in df.columns], F.col("_b").alias("partner"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean, std, min, max, median, n``; medians are exact, and no task holds a column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.inline(pairs))
    v = F.col("v")
    sums = rows.groupBy("column").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    middle = quantiles(rows, ["column"], "v", [0.5]).select("column", F.col("q")[0].alias("median"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = names.join(F.broadcast(sums), "column", "left").join(F.broadcast(middle), "column", "left")  # one row a column
    return out.select("column", "mean", "std", "min", "max", "median", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def tree_summary(df: DataFrame) -> DataFrame:
    """``path, type, elements``: each column's type and how many elements it holds in all."""
    rows = []
    for f in df.schema.fields:
        array = f.dataType.simpleString().startswith("array")
        n = F.coalesce(F.sum(F.size(f.name)), F.lit(0)) if array else F.count(f.name)
        rows.append(F.struct(F.lit(f.name).alias("path"), F.lit(f.dataType.simpleString()).alias("type"), n.cast("bigint").alias("elements")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
