"""Rasters of unlike shapes in one table: ``shape`` (rows, columns, channels) beside ``data``, row-major with channels last.

Sizes, boxes and shifts are column expressions. Resampling takes the rows of an Arrow batch that share shape and target as
one stack, as many at a time as a number of pixels allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.arrays import u
from eospark.operators.raster import resampled

#: Values of a stack, in and out, at most (a larger raster is a stack of its own).
STACK = 1 << 22
#: The ranges of the types that results are clipped to.
RANGES = {"uint8": (0, 255), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1)}
#: The aspect ratios of distorted boxes.
ASPECTS = (0.75, 1.33)


def by_side(shape: Column, target: int, small: bool) -> Column:
    """Rows and columns when the smaller (or longer) side becomes ``target`` and the aspect is kept; halves round to even."""
    side = (F.least if small else F.greatest)(shape[0], shape[1])
    return F.transform(F.slice(shape, 1, 2), lambda n: F.rint(n * (F.lit(float(target)) / side)).cast("int"))


def by_reference(shape: Column, r: Column, reference: int, lo: float, hi: float) -> Column:
    """The largest size within a square of a random side, ``reference`` times a ratio from [lo, hi), with the aspect kept."""
    side = F.floor((lo + r * (hi - lo)) * reference)
    factor = F.least(side / shape[0], side / shape[1])
    return F.transform(F.slice(shape, 1, 2), lambda n: F.rint(n * factor).cast("int"))


def distorted_box(shape: Column, key: Column, salt: str, area: tuple[float, float] = (0.05, 1.0), aspects: tuple[float, float] = ASPECTS) -> Column:
    """``array(y, x, height, width)``: a box whose share of the area, aspect and place are drawn by the row's key.

    A box that is too high or wide for the image is cut to fit; it has a pixel at least.
    """
    draw = lambda k, lo, hi: lo + u(key, f"{salt}{k}") * (hi - lo)
    size = shape[0] * shape[1] * draw("area", *area)
    ratio = draw("aspect", *aspects)
    fit = lambda v, n: F.least(F.greatest(F.rint(v), F.lit(1.0)), n).cast("int")
    h, w = fit(F.sqrt(size / ratio), shape[0]), fit(F.sqrt(size * ratio), shape[1])
    at = lambda k, n, m: F.floor(u(key, f"{salt}{k}") * (n - m + 1)).cast("int")
    return F.array(at("y", shape[0], h), at("x", shape[1], w), h, w)


def shift_reflect(data: Column, shape: Column, dy: Column, dx: Column) -> Column:
    """The raster seen from ``dy, dx`` pixels further; what lies beyond an edge is reflected at the edge pixel. In the row."""

    def inside(i: Column, n: Column) -> Column:
        i = F.abs(i)
        return F.when(i > n - 1, 2 * (n - 1) - i).otherwise(i)

    def one(_: Column, p: Column) -> Column:
        c, w = shape[2], shape[1]
        y, x = F.floor(p / (c * w)), F.floor(p / c) % w
        return F.get(data, ((inside(y + dy, shape[0]) * w + inside(x + dx, w)) * c + p % c).cast("int"))

    return F.transform(data, one)


def resample(df: DataFrame, out: dict[str, tuple[str, str | None]], size: str, shape: str = "shape", box: str | None = None) -> DataFrame:
    """Resize array columns to the row's ``size`` (rows, columns), after a crop to its ``box`` (y, x, height, width) if given.

    ``out`` maps a column to its method (``nearest``, ``bilinear``, ``area``) and the type whose range it is clipped and
    truncated to, if any; so an image and its mask are resampled together by unlike rules. All have the channels that their
    length implies. ``shape`` is set to the new one. A null array stays null; other columns stay as they are.
    """
    names, fields = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            if not len(f):
                continue
            f = f.copy()
            shapes, sizes = (list(map(tuple, f[c])) for c in (shape, size))
            boxes = list(map(tuple, f[box])) if box else [(0, 0, s[0], s[1]) for s in shapes]
            like: dict[tuple, list[int]] = {}
            for i in range(len(f)):
                like.setdefault((shapes[i][:2], boxes[i][2:], sizes[i][:2]), []).append(i)
            for col, (method, kind) in out.items():
                values, new = f[col].tolist(), [None] * len(f)
                for ((h, w), (bh, bw), (nh, nw)), rows in like.items():
                    rows = [i for i in rows if values[i] is not None]
                    c = len(values[rows[0]]) // (h * w) if rows else 1
                    step = max(1, STACK // max(1, (h * w + nh * nw) * c))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        x = np.empty((len(part), bh, bw, c))
                        for k, i in enumerate(part):
                            y0, x0 = boxes[i][:2]
                            x[k] = np.asarray(values[i], float).reshape(h, w, c)[y0 : y0 + bh, x0 : x0 + bw]
                        y = resampled(x, (nh, nw), method)
                        if kind:
                            y = np.trunc(np.clip(y, *RANGES[kind]))
                        for k, i in enumerate(part):
                            new[i] = y[k].ravel()
                f[col] = new
            f[shape] = [[*s[:2], t[2]] for s, t in zip(sizes, shapes, strict=True)]
            yield f[names]

    return df.mapInPandas(run, fields)
