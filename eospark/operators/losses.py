"""Losses as column expressions: one value a row from arrays of logits and targets, or from numbers.

``weighted_mean`` turns per-pixel values into per-example ones; a job's mean is then an ``avg``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import div0, log_sigmoid, log_softmax, log_sum_exp, sigmoid, softmax, total
from eospark.functions.storage import staged


def softmax_xent(logits: Column, targets: Column, kl: bool = False) -> Column:
    loss = -total(F.zip_with(targets, log_softmax(logits), lambda y, p: y * p))
    return loss + total(F.transform(targets, lambda y: y * F.log(F.greatest(y, F.lit(1e-8))))) if kl else loss


def lq_loss(logits: Column, targets: Column, q: float = 0.7) -> Column:
    if q == 0:
        return softmax_xent(logits, targets)
    p = total(F.zip_with(targets, softmax(logits), lambda y, p: y * p))
    return (1 - F.pow(p + 1e-7, F.lit(q))) / q


def sigmoid_xent(logits: Column, targets: Column, mean: bool = True) -> Column:
    """Mean over the classes, or their sum, which is what weighted pixels are summed by."""
    each = F.zip_with(logits, targets, lambda z, y: -(y * log_sigmoid(z) + (1 - y) * log_sigmoid(-z)))
    return total(each) / F.size(logits) if mean else total(each)


def partial_label_loss(logits: Column, allowed: Column, entropy_weight: float = 0.1) -> Column:
    """How far the probability of all allowed labels is from 1, plus the prediction's weighted entropy."""
    kept = F.transform(F.filter(F.arrays_zip(logits.alias("z"), allowed.alias("y")), lambda x: x["y"] > 0), lambda x: x["z"])
    entropy = -total(F.zip_with(softmax(logits), log_softmax(logits), lambda p, l: p * l))
    return log_sum_exp(logits) - log_sum_exp(kept) + entropy_weight * entropy


def softmax_focal(logits: Column, targets: Column, alpha: float | list[float] = 0.25, gamma: float = 2.0) -> Column:
    scaled = F.zip_with(targets, log_softmax(logits), lambda y, p: y * p)
    if isinstance(alpha, list):
        scaled = F.zip_with(scaled, F.array(*[F.lit(float(a)) for a in alpha]), lambda v, a: v * a)
    else:
        scaled = F.transform(scaled, lambda v: v * alpha)
    l = total(scaled)
    return -l * F.pow(1 - F.exp(l), F.lit(gamma))


def l2_loss(p: Column, y: Column, as_mse: bool = True) -> Column:
    return (p - y) * (p - y) * (1.0 if as_mse else 0.5)


def l1_loss(p: Column, y: Column) -> Column:
    return F.abs(p - y)


def huber_loss(p: Column, y: Column, delta: float = 1.0) -> Column:
    a = F.abs(p - y)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def smape_loss(p: Column, y: Column, eps: float = 1e-8) -> Column:
    return F.abs(p - y) / ((F.abs(p) + F.abs(y)) / 2 + eps)


def gnll_loss(p: Column, y: Column, log_var: Column, eps: float = 1e-8) -> Column:
    return ((p - y) * (p - y) / (F.exp(log_var) + eps) + log_var) / 2


def _activated(xs: Column, name: str) -> Column:
    return {"none": lambda: xs, "sigmoid": lambda: F.transform(xs, sigmoid), "softmax": lambda: softmax(xs)}[name]()


def kld_loss(logits: Column, labels: Column, gamma: float | None = None, activation: str = "sigmoid", labels_activation: str = "none") -> Column:
    """Divergence of predictions from label distributions; a label of 0 adds nothing."""
    p, y = _activated(logits, activation), _activated(labels, labels_activation)
    loss = total(F.zip_with(y, p, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(F.greatest(b, F.lit(1e-38))))).otherwise(0.0)))
    return loss if gamma is None else F.pow(loss + 1e-7, F.lit(gamma))


def weighted_mean(df: DataFrame, key: str, loss: Column, weight: Column | None = None, name: str = "loss", normalize: bool = True) -> DataFrame:
    """``key, loss``: per-example means over pixels by weight. Without weight the loss is 0."""
    weight = F.lit(1.0) if weight is None else weight
    s = df.groupBy(key).agg(F.sum(loss * weight).alias("s"), F.sum(weight).alias("w"))
    return s.select(key, (div0(F.col("s"), F.greatest("w", F.lit(2e-38))) if normalize else F.col("s")).alias(name))


def generalized_dice(
    df: DataFrame, key: str, probs: Column, targets: Column, weight: Column | None = None, norm_type: str = "tanimoto", eps: float = 1e-3,
    beta: float = 0.7, dual: bool = False, class_weights: list[float] | None = None,
) -> DataFrame:
    """``key, loss``: 1 minus the mean overlap over classes; pixels count where the weight is positive."""
    weight = F.lit(1.0) if weight is None else weight
    rows = df.where(weight > 0).select(key, F.posexplode(F.arrays_zip(probs.alias("p"), targets.alias("y"))).alias("c", "z")).select(key, "c", "z.p", "z.y")

    def overlap(p: Column, y: Column, tag: str) -> list[Column]:
        return [F.sum(p * y).alias(f"i{tag}"), F.sum(p).alias(f"p{tag}"), F.sum(y).alias(f"y{tag}"), F.sum(p * p).alias(f"pp{tag}"), F.sum(y * y).alias(f"yy{tag}")]

    p, y = F.col("p"), F.col("y")
    s = rows.groupBy(key, "c").agg(*overlap(p, y, ""), *overlap(1 - p, 1 - y, "_d"))

    def score(tag: str) -> Column:
        i, sp, sy, pp, yy = (F.col(x + tag) for x in ("i", "p", "y", "pp", "yy"))
        norm = {
            "standard": lambda: sp + sy, "squared": lambda: pp + yy, "tanimoto": lambda: 2 * (pp + yy - i),
            "tversky": lambda: 2 * ((1 - beta) * pp + beta * yy),
        }[norm_type]()
        return (2 * i + eps) / (norm + eps)

    value = (score("") + score("_d")) / 2 if dual else score("")
    w = F.get(F.array(*[F.lit(float(x)) for x in class_weights]), F.col("c")) if class_weights else F.lit(1.0)
    return s.groupBy(key).agg((1 - F.sum(value * w) / F.sum(w)).alias("loss"))


def weighted_losses_sum(losses: dict[str, tuple[Column, float]], normalize: bool = True) -> list[Column]:
    """The weighted sum of losses as ``loss``, and each loss by its name."""
    scale = sum(w for _, w in losses.values()) if normalize else 1.0
    whole = sum((c * w for c, w in losses.values()), F.lit(0.0)) / scale
    return [whole.alias("loss"), *[c.alias(n) for n, (c, _) in losses.items()]]


def nt_xent(
    df: DataFrame, batch: str = "batch_id", pair: str = "pair", view: str = "view", vector: str = "v", temperature: float = 1.0, block: int = 256
) -> DataFrame:
    """``batch_id, pair, loss`` of paired views: within a batch the other view is the positive, all other vectors are negatives.

    Pairs of a batch are dealt into blocks of about ``block`` by hash. Each two blocks meet as one row, whose similarities
    (four times block squared at most at a time) are reduced to a log-sum-exp for each vector; those of one vector over
    all blocks are combined. So memory doesn't grow with the batch. Pairs without exactly two views are left out.
    """
    import numpy as np
    import pandas as pd

    src = df.select(F.col(batch).alias("batch_id"), F.col(pair).alias("pair"), F.struct(F.col(view).alias("view"), F.col(vector).alias("v")).alias("x"))
    both = src.groupBy("batch_id", "pair").agg(F.array_sort(F.collect_list("x")).alias("x")).where("size(x) = 2")
    both = staged(both.select("batch_id", "pair", F.col("x")[0]["v"].alias("a"), F.col("x")[1]["v"].alias("b")), "pairs")
    blocks = both.groupBy("batch_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    at = F.pmod(F.xxhash64("pair"), F.col("blocks")).alias("block")
    dealt = both.join(F.broadcast(blocks), "batch_id").select("batch_id", "blocks", at, F.struct("pair", "a", "b").alias("p"))  # a row a batch
    dealt = staged(dealt.groupBy("batch_id", "blocks", "block").agg(F.collect_list("p").alias("rows")), "blocks")
    left = dealt.select("batch_id", "block", "rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    right = dealt.select("batch_id", F.col("block").alias("other"), F.col("rows").alias("others"))
    met = left.join(right, ["batch_id", "other"]).select("batch_id", (F.col("block") == F.col("other")).alias("own"), "rows", "others")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack = lambda rows: np.stack([np.stack([r["a"], r["b"]]) for r in rows])
        for f in frames:
            for key, own, rows, others in zip(f["batch_id"], f["own"], f["rows"], f["others"], strict=True):
                x, y = stack(rows), stack(others)
                sim = x.reshape(-1, x.shape[2]) @ y.reshape(-1, y.shape[2]).T / temperature
                if own:
                    np.fill_diagonal(sim, -np.inf)
                top = sim.max(axis=1)
                lse = (top + np.log(np.exp(sim - top[:, None]).sum(axis=1))).reshape(-1, 2)
                positive = (x[:, 0] * x[:, 1]).sum(axis=1) / temperature
                yield pd.DataFrame({"batch_id": key, "pair": [r["pair"] for r in rows], "a": lse[:, 0], "b": lse[:, 1], "positive": positive})

    ids = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("batch_id", "pair"))
    parts = met.mapInPandas(run, f"{ids}, a double, b double, positive double")
    # As many elements as the batch has blocks.
    parts = parts.groupBy("batch_id", "pair").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.first("positive").alias("positive"))

    each = log_sum_exp(F.col("a")) + log_sum_exp(F.col("b"))
    return parts.select("batch_id", "pair", (each - 2 * F.col("positive")).alias("loss"))


REGISTRY = {
    f.__name__: f
    for f in (softmax_xent, lq_loss, sigmoid_xent, partial_label_loss, softmax_focal, l2_loss, l1_loss, huber_loss, smape_loss, gnll_loss, kld_loss)
}


def get_loss(name: str, **params):
    """A loss by its registered or dotted name, with parameters fixed."""
    from functools import partial
    from importlib import import_module

    if name in REGISTRY:
        return partial(REGISTRY[name], **params)
    if "." not in name:
        raise KeyError(f"unknown loss {name}")
    module, _, attr = name.rpartition(".")
    return partial(getattr(import_module(module), attr), **params)
