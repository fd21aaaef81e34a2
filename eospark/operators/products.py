"""Predictions shaped for metrics, and products of inference."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import argmax, one_hot, softmax
from eospark.operators.losses import softmax_xent


def with_prediction(df: DataFrame, logits: str = "logits", name: str = "pred") -> DataFrame:
    """The index of the first largest logit; NaN is the largest."""
    return df.withColumn(name, argmax(F.col(logits)))


def eval_weights(label: Column, exclude_background: bool = False, mask: Column | None = None, weight: Column | None = None) -> Column:
    out = (label > 0).cast("double") if exclude_background else F.lit(1.0)
    for part in (mask, weight):
        out = out if part is None else out * part.cast("double")
    return out


def seg_to_cls(df: DataFrame, key: str, classes: int, logits: str = "logits", pixel_label: str = "label", example_label: str = "example_label") -> DataFrame:
    """``key, logits``: softmax summed over the pixels whose label is the example's."""
    p = softmax(F.col(logits))
    rows = df.where(F.col(pixel_label) == F.col(example_label)).select(key, p.alias("p"))
    return rows.groupBy(key).agg(F.array(*[F.sum(F.get("p", F.lit(c))) for c in range(classes)]).alias("logits"))


def map_labels(df: DataFrame, mapping: dict[int, int], label: str = "label") -> DataFrame:
    """Replacements one after the other: a later one may replace an earlier one's result."""
    c = F.col(label)
    for a, b in mapping.items():
        c = F.when(c == a, b).otherwise(c)
    return df.withColumn(label, c)


def map_predictions(df: DataFrame, mapping: dict[int, int], classes: int, logits: str = "logits") -> DataFrame:
    """``probs``: the softmax mass of each mapped class under its new class; ``pred``: the largest. Classes that are not
    mapped get nothing."""
    p = softmax(F.col(logits))
    sums = [sum((F.get("_p", F.lit(a)) for a, b in mapping.items() if b == c), F.lit(0.0)) for c in range(classes)]
    out = df.withColumn("_p", p).withColumn("probs", F.array(*sums)).drop("_p")
    return out.withColumn("pred", argmax(F.col("probs")))


def filter_logits(logits: Column, bar: Column) -> Column:
    """Logits plus a vector of the example, such as minus infinity for classes that cannot be."""
    return F.zip_with(logits, bar, lambda a, b: a + b)


def select_head(heads: Column, head: Column) -> Column:
    """The logits of one of several heads; an index out of range raises."""
    return F.element_at(heads, (head + 1).cast("int"))


def infer(df: DataFrame, keys: list[str], logits: str = "logits", discrete: bool = True, exclude_background: bool = False) -> DataFrame:
    """``keys, preds, probs``: class and probabilities, these as integers from 0 to 250 unless ``discrete`` is off."""
    p = softmax(F.col(logits))
    p = F.slice(p, F.lit(2), F.size(p) - 1) if exclude_background else p
    probs = F.transform(p, lambda v: F.floor(250 * v).cast("smallint")) if discrete else p
    return df.select(*keys, argmax(F.col(logits)).alias("preds"), probs.alias("probs"))


def prediction_stats(df: DataFrame, key: str, logits: str = "logits") -> DataFrame:
    """Class counts of each example."""
    return df.groupBy(key, argmax(F.col(logits)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_area(stats: DataFrame) -> DataFrame:
    """Class counts over all examples."""
    return stats.groupBy("class").agg(F.sum("n").alias("n"))


def panoptic(semantics: Column, instances: Column, min_fraction: float = 0.0) -> Column:
    """``struct<instance: array<int>, class: array<int>>`` of a raster whose pixels have an array of logits each: an instance's
    class is that of its pixels' summed semantic logits; instances with at most ``min_fraction`` of the pixels become 0.

    The votes are taken within the row, on arrays of an Arrow batch, so nothing is shuffled.
    """
    import numpy as np
    import pandas as pd

    @F.pandas_udf("instance array<int>, class array<int>")
    def vote(sem, inst):
        out = []
        for s, i in zip(sem, inst, strict=True):
            if s is None or not len(s):
                out.append(([], []))
                continue
            s, at = np.stack(s), np.stack(i).argmax(axis=1)
            found, at = np.unique(at, return_inverse=True)
            sums = np.zeros((len(found), s.shape[1]))
            np.add.at(sums, at, s)
            large = np.bincount(at) / len(at) > min_fraction
            out.append((np.where(large, found, 0)[at].astype(np.int32), sums.argmax(axis=1)[at].astype(np.int32)))
        return pd.DataFrame(out, columns=["instance", "class"])

    return vote(semantics, instances)


def multitask(df: DataFrame, tasks: dict[str, int], logits: str = "logits") -> DataFrame:
    """One row: the sum of the tasks' mean losses, the mean of their accuracies, and each task's loss."""
    losses = {t: F.avg(softmax_xent(F.col(logits), one_hot(F.col(t), n))) for t, n in tasks.items()}
    accs = [F.avg((argmax(F.col(logits)) == F.col(t)).cast("int")) for t in tasks]
    return df.agg(sum(losses.values()).alias("loss"), (sum(accs) / len(accs)).alias("acc"), *[v.alias(f"loss_{t}") for t, v in losses.items()])


def _rasters(*cols, size: int):
    import numpy as np

    return [np.stack(c.to_numpy()).reshape(len(c), size, size) for c in cols]


def supres_losses(df: DataFrame, size: int, border: int = 3, brightness_bias: bool = True) -> DataFrame:
    """``id, l1, sr_mse, cpsnr`` of square rasters ``sr`` and ``hr`` (and an optional ``mask``): the best over all shifts.

    The vectorised helper takes a whole Arrow batch at a time, so shifts make no rows.
    """
    has_mask = "mask" in df.columns

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            sr, hr = _rasters(f["sr"], f["hr"], size=size)
            mask = _rasters(f["mask"], size=size)[0] if has_mask else np.ones_like(hr)
            n = size - 2 * border
            sr = sr[:, border : size - border, border : size - border]
            l1, mse = [], []
            for i in range(2 * border + 1):
                for j in range(2 * border + 1):
                    m = mask[:, i : i + n, j : j + n]
                    h, s, k = hr[:, i : i + n, j : j + n] * m, sr * m, m.sum(axis=(1, 2))
                    if brightness_bias:
                        s = (s + ((h - s).sum(axis=(1, 2)) / k)[:, None, None]) * m
                    l1.append(np.abs(h - s).sum(axis=(1, 2)) / k)
                    mse.append(((h - s) ** 2).sum(axis=(1, 2)) / k)
            best = np.min(mse, axis=0)
            with np.errstate(divide="ignore"):
                psnr = -10 * np.log10(best)
            yield pd.DataFrame({"id": f["id"], "l1": np.min(l1, axis=0), "sr_mse": best, "cpsnr": psnr})

    cols = ["id", "sr", "hr", *(["mask"] if has_mask else [])]
    return df.select(*cols).mapInPandas(run, "id bigint, l1 double, sr_mse double, cpsnr double")


def shift_search(df: DataFrame, size: int, border: int = 3, loss=None) -> DataFrame:
    """``id, loss``: the least per-example loss of ``sr`` against ``hr`` over all shifts. ``loss`` takes two arrays of
    rasters and gives one value each; without one it is the mean absolute difference."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        score = loss or (lambda p, y: np.abs(p - y).mean(axis=(1, 2)))
        for f in frames:
            if not len(f):
                continue
            sr, hr = _rasters(f["sr"], f["hr"], size=size)
            n = size - 2 * border
            sr = sr[:, border : size - border, border : size - border]
            steps = range(2 * border + 1)
            yield pd.DataFrame({"id": f["id"], "loss": np.min([score(sr, hr[:, i : i + n, j : j + n]) for i in steps for j in steps], axis=0)})

    return df.select("id", "sr", "hr").mapInPandas(run, "id bigint, loss double")


def ssim(df: DataFrame, height: int, width: int, c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """``id, ssim``: the mean structural dissimilarity of rasters ``a`` and ``b`` over 3 x 3 windows."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            x, y = (np.stack(f[c].to_numpy()).reshape(len(f), height, width) for c in ("a", "b"))
            pool = lambda v: sum(v[:, i : height - 2 + i, j : width - 2 + j] for i in range(3) for j in range(3)) / 9
            mx, my = pool(x), pool(y)
            sx, sy, sxy = pool(x * x) - mx * mx, pool(y * y) - my * my, pool(x * y) - mx * my
            full = (2 * mx * my + c1) * (2 * sxy + c2) / ((mx * mx + my * my + c1) * (sx + sy + c2))
            yield pd.DataFrame({"id": f["id"], "ssim": np.clip((1 - full) / 2, 0, 1).mean(axis=(1, 2))})

    return df.select("id", "a", "b").mapInPandas(run, "id bigint, ssim double")
