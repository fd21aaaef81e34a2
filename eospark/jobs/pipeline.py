"""The user's surface: operations with names, composed by a small language.

``"onehot(10)|keep('id','labels')"`` is a chain of registered operations on DataFrames. Arguments are Python literals;
empty parts are skipped; an unknown name or bad syntax raises.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.operators import project, raster

Op = Callable[[DataFrame], DataFrame]
_OPS: dict[str, Callable[..., Op]] = {}


def register(name: str, replace: bool = False):
    """Register a function that takes the arguments and gives a ``DataFrame -> DataFrame`` function."""

    def put(f: Callable[..., Op]) -> Callable[..., Op]:
        if name in _OPS and not replace:
            raise KeyError(f"{name} is registered already")
        _OPS[name] = f
        return f

    return put


def known(name: str) -> bool:
    return name in _OPS


@contextmanager
def temporary_ops(**ops: Callable[..., Op]) -> Iterator[None]:
    """Operations that exist, or are replaced, within the block only."""
    before = dict(_OPS)
    _OPS.update(ops)
    try:
        yield
    finally:
        _OPS.clear()
        _OPS.update(before)


def parse(text: str) -> list[tuple[str, list, dict]]:
    """(name, arguments, named arguments) of each part."""
    out = []
    try:
        parts = _split(text)
        for part in parts:
            node = ast.parse(part, mode="eval").body
            if isinstance(node, ast.Name):
                out.append((node.id, [], {}))
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                named = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
                out.append((node.func.id, [ast.literal_eval(a) for a in node.args], named))
            else:
                raise ValueError(part)
    except (SyntaxError, ValueError) as e:
        raise ValueError(f"bad pipeline {text!r}") from e
    return out


def _split(text: str) -> list[str]:
    """Parts between bars that are not inside quotes or brackets."""
    parts, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "|" and not depth and not quote:
            parts.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*parts, part] if p.strip()]


def preprocess(text: str, dataset: str | None = None, splits: str | None = None) -> Op:
    """The composed operation. Operations may read the columns ``__dataset`` and ``__splits``, which are gone after."""
    chain = []
    for name, args, named in parse(text):
        if name not in _OPS:
            raise KeyError(f"unknown operation {name}")
        chain.append(_OPS[name](*args, **named))

    def run(df: DataFrame) -> DataFrame:
        extra = {k: v for k, v in (("__dataset", dataset), ("__splits", splits)) if v is not None}
        df = df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df
        for op in chain:
            df = df.transform(op)
        return df.drop(*extra)

    return run


def _in_out(expr):
    """An operation from ``expr(column, ...)`` with the arguments ``key``, or ``inkey`` and ``outkey``."""

    def make(*args, key: str | None = None, inkey: str | None = None, outkey: str | None = None, **named) -> Op:
        source, target = inkey or key or "image", outkey or key or inkey or "image"

        def run(df: DataFrame) -> DataFrame:
            project.need(df, source)
            return df.withColumn(target, expr(F.col(source), *args, **named))

        return run

    return make


register("keep")(lambda *names: lambda df: project.keep(df, *names))
register("drop")(lambda *names: lambda df: project.drop(df, *names))
register("copy")(lambda inkey, outkey: lambda df: project.copy(df, inkey, outkey))
register("rename")(lambda **names: lambda df: project.rename(df, **names))
register("cast")(lambda key, dtype: lambda df: project.cast(df, key, dtype))
register("filter")(lambda spec: lambda df: project.filter_spec(df, spec))
register("setdefault")(lambda key, value: lambda df: project.setdefault(df, key, value))
register("invert_bool")(lambda *keys: lambda df: project.invert_bool(df, *keys))
register("flatten")(lambda: project.flatten_keys)
register("value_range")(
    _in_out(lambda c, vmin=-1.0, vmax=1.0, in_min=0.0, in_max=255.0, clip_values=False: raster.value_range(
        c, vmin, vmax, in_min if isinstance(in_min, list) else [in_min], in_max if isinstance(in_max, list) else [in_max], clip_values))
)
register("onehot")(_in_out(lambda c, depth, on=1.0, off=0.0: raster.onehot(c, depth, on=on, off=off)))
register("remap")(_in_out(lambda c, mapping, default_value=0: project.remap(c, mapping, default_value)))
register("select_channels")(_in_out(lambda c, channels, wanted: raster.select_channels(c, channels, wanted)))
