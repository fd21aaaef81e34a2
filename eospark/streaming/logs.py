"""Metric logs, as tables or streams: windows by step, early stopping, alerts, progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import argmax
from eospark.functions.storage import staged
from eospark.operators.global_order import ordered, running_max


def log_windows(df: DataFrame, every: int) -> DataFrame:
    """``run, metric, window, value``: means between log events. The same on tables and streams."""
    w = F.floor((F.col("step") - 1) / every).cast("bigint")
    return df.groupBy("run", "metric", w.alias("window")).agg(F.avg("value").alias("value"))


def nonfinite_alert(df: DataFrame, every: int) -> DataFrame:
    """``run, window, first_step, last_step, n`` of values that are NaN or infinite."""
    bad = df.where(F.isnan("value") | (F.abs("value") == float("inf")))
    w = F.floor((F.col("step") - 1) / every).cast("bigint")
    return bad.groupBy("run", w.alias("window")).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"))


def better_is_more(metric: str) -> bool:
    return "loss" not in metric


def early_stop_windows(df: DataFrame, patience: int, start: int = 0, more: bool = True) -> DataFrame:
    """``run, metric, best_step, best, stop_step`` without a least improvement, by running extremes over each run's log.

    Runs that never stop have no ``stop_step``; ties do not improve. A log may span many partitions.
    """
    keys, sign = ["run", "metric"], 1.0 if more else -1.0
    # The largest value with the least step.
    seen = running_max(df, keys, ["step"], F.struct((F.col("value") * sign).alias("v"), (-F.col("step")).alias("s")), "_best")
    best, step = F.col("_best.v") * sign, -F.col("_best.s")
    ends = (F.col("step") >= start) & (F.col("step") >= step + patience)
    now = F.struct(F.col("step").alias("stop_step"), step.alias("best_step"), best.alias("best"))
    out = seen.groupBy(*keys).agg(F.min(F.when(ends, now)).alias("_stop"), F.max("_best").alias("_last"))
    last = F.struct(F.lit(None).cast("bigint").alias("stop_step"), (-F.col("_last.s")).alias("best_step"), (F.col("_last.v") * sign).alias("best"))
    return out.select(*keys, F.coalesce("_stop", last).alias("r")).select(*keys, "r.best_step", "r.best", "r.stop_step")


class EarlyStopping:
    """The state of one run and metric: its best value and step. Steps at or before the last one seen are ignored."""

    def __init__(self, patience: int, min_delta: float = 0.0, start: int = 0, more: bool = True):
        self.patience, self.delta, self.start, self.sign = patience, min_delta, start, 1.0 if more else -1.0

    def scan(self, rows: Iterator[tuple[int, float]], state: tuple | None = None) -> tuple:
        """(best, best_step, last_step, stop_step) after rows in the order of steps."""
        best, best_step, last, stop = state or (None, 0, -1, None)
        for step, value in rows:
            if step <= last or stop is not None:
                continue
            last = step
            v = value * self.sign
            if best is None or v > best + self.delta:
                best, best_step = v, step
            elif step >= self.start and step >= best_step + self.patience:
                stop = step
        return best, best_step, last, stop


def _records(steps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and steps that exceed all before them in a range, values ascending. NaN exceeds nothing."""
    before = np.fmax.accumulate(np.concatenate([[-np.inf], values]))[:-1]
    own = values > before
    own |= np.isneginf(values) & (np.cumsum(~np.isnan(values)) == 1)  # the first one is a record whatever it is
    return values[own], steps[own]


def early_stop(df: DataFrame, patience: int, min_delta: float, start: int = 0, more: bool = True) -> DataFrame:
    """``early_stop_windows`` with a least improvement, which depends on the order of rows.

    A log of any length is worked on in ranges of steps. From a given best value the next improvement within a range is a
    record of that range (a value above all before it in the range), and so are all that follow; so a range's outcome, for
    whatever best value it is entered with, follows from its records. One state a range is carried through these outcomes;
    then every range, entered with its state, looks for the first step that stops. NaN never improves; of equal steps one counts.
    """
    import pandas as pd

    if min_delta < 0:
        raise ValueError("a least improvement is not negative")
    sign, keys = 1.0 if more else -1.0, ["run", "metric"]
    src = df.select(*keys, F.col("step").cast("bigint").alias("step"), (F.col("value").cast("double") * sign).alias("value"))
    rows = ordered(src, [F.col(c) for c in (*keys, "step")])
    kinds = f"run {df.schema['run'].dataType.simpleString()}, metric {df.schema['metric'].dataType.simpleString()}"

    def jumps(values: np.ndarray) -> np.ndarray:
        """For each record the next one that improves on it by enough; their count if there is none."""
        return np.searchsorted(values, values + min_delta, side="right")

    def outcomes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").drop_duplicates("step")
        values, steps = _records(pdf["step"].to_numpy(), pdf["value"].to_numpy())
        to = jumps(values)
        last = np.arange(len(values))
        for i in range(len(values) - 2, -1, -1):
            last[i] = last[to[i]] if to[i] < len(values) else i
        # Neighbours with one outcome are one entry: it holds from the best value before the first of them on.
        new = np.ones(len(values), bool)
        new[:-1] = last[1:] != last[:-1]
        some = {"upto": values[new], "best": values[last[new]], "best_step": steps[last[new]]} if len(values) else {"upto": [None], "best": [0.0], "best_step": [0]}
        return pd.DataFrame({**some, "run": key[0], "metric": key[1], "_part": key[2]})[["run", "metric", "_part", "upto", "best", "best_step"]]

    def carried(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The state in which each range is entered. One row a range and outcome."""
        best, step, out = None, None, []
        for part, own in pdf.sort_values(["_part", "upto"]).groupby("_part"):
            out.append((key[0], key[1], part, best, step))
            own = own[own["upto"].notna()]
            i = 0 if best is None else int(np.searchsorted(own["upto"].to_numpy(), best + min_delta, side="right"))
            if i < len(own):
                best, step = float(own["best"].iloc[i]), int(own["best_step"].iloc[i])
        return pd.DataFrame(out, columns=["run", "metric", "_part", "_best", "_step"]).astype({"_best": "Float64", "_step": "Int64"})

    def stops(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").drop_duplicates("step")
        steps, all_values = pdf["step"].to_numpy(), pdf["value"].to_numpy()
        values, at = _records(steps, all_values)
        best, step = pdf["_best"].iloc[0], pdf["_step"].iloc[0]
        fresh = pd.isna(best)
        hits, i = [], 0 if fresh else int(np.searchsorted(values, best + min_delta, side="right"))
        to = jumps(values)
        while i < len(values):
            hits.append(i)
            i = int(to[i])
        # The best value and its step at each row, and whether the row itself improves.
        places = np.searchsorted(steps, at[hits])
        latest = np.searchsorted(places, np.arange(len(steps)), side="right")
        best_at = np.concatenate([[np.nan if fresh else best], values[hits]])[latest]
        step_at = np.concatenate([[0 if fresh else step], at[hits]])[latest]
        ends = (steps >= max(start, 0)) & (steps >= step_at + patience)
        ends[places] = False
        if fresh and not len(places):
            ends[:1] = False  # the first value of a run is no stop
        first = int(np.argmax(ends)) if ends.any() else len(steps) - 1
        stop = int(steps[first]) if ends.any() else None
        return pd.DataFrame({"run": [key[0]], "metric": [key[1]], "_part": [key[2]], "best_step": [int(step_at[first])], "best": [float(best_at[first])], "stop_step": pd.array([stop], dtype="Int64")})

    found = rows.groupBy(*keys, "_part").applyInPandas(outcomes, f"{kinds}, _part bigint, upto double, best double, best_step bigint")
    states = staged(found.groupBy(*keys).applyInPandas(carried, f"{kinds}, _part bigint, _best double, _step bigint"), "states")
    entered = rows.join(states, [*keys, "_part"], "left")
    each = entered.groupBy(*keys, "_part").applyInPandas(stops, f"{kinds}, _part bigint, best_step bigint, best double, stop_step bigint")
    # The first range that stops, or else the last one, has the outcome.
    rank = F.when(F.col("stop_step").isNotNull(), F.col("_part")).otherwise(F.lit(1 << 40) - F.col("_part"))
    out = each.groupBy(*keys).agg(F.min_by(F.struct("best_step", "best", "stop_step"), rank).alias("r"))
    return out.select(*keys, "r.best_step", (F.col("r.best") * sign).alias("best"), "r.stop_step")


def early_stop_stream(stream: DataFrame, patience: int, min_delta: float = 0.0, start: int = 0, more: bool = True) -> DataFrame:
    """The same on a stream: state is a few numbers a key; out-of-order steps are ignored."""
    import pandas as pd

    rule = EarlyStopping(patience, min_delta, start, more)

    def run(key, frames, state):
        rows = sorted((int(s), float(v)) for f in frames for s, v in zip(f["step"], f["value"], strict=True))
        old = None
        if state.exists:
            best, step, last, stop = state.get
            old = (best, step, last, None if stop < 0 else stop)
        best, step, last, stop = rule.scan(iter(rows), old)
        state.update((best, step, last, -1 if stop is None else stop))
        yield pd.DataFrame({"run": [key[0]], "metric": [key[1]], "best_step": [step], "best": [best * rule.sign], "stop_step": pd.array([stop], dtype="Int64")})

    run_type = stream.schema["run"].dataType.simpleString()
    out = f"run {run_type}, metric string, best_step bigint, best double, stop_step bigint"
    return stream.groupBy("run", "metric").applyInPandasWithState(run, out, "best double, step bigint, last bigint, stop bigint", "update", "NoTimeout")


def confusion_counts(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Running counts ``pred, true, n``: the state that batches are merged into, on tables and streams."""
    return df.groupBy(argmax(F.col(logits)).alias("pred"), F.col(label).alias("true")).agg(F.count(F.lit(1)).alias("n"))


def progress(df: DataFrame, examples_per_epoch: int, total_steps: int) -> DataFrame:
    """From a log of ticks (``run, step, time`` in seconds, ``pause`` since the last tick, ``batch``): examples seen,
    epoch, progress, and examples a second between ticks without pauses. A run may span many partitions."""
    src = df.select("run", "step", "time", "pause", "batch")
    rows = running_max(src, ["run"], ["step", "time"], F.struct("step", "time"), "_last", inclusive=False)
    dt = F.col("time") - F.col("_last.time") - F.col("pause")
    new = (F.col("step") - F.col("_last.step")) * F.col("batch")
    seen = F.col("step") * F.col("batch")
    return rows.select(
        "run", "step", seen.alias("examples"), (seen / examples_per_epoch).alias("epoch"), (F.col("step") / total_steps).alias("progress"),
        F.when(dt > 0, new / dt).alias("examples_per_sec"),
    )
