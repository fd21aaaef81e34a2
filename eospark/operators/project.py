"""Filters, projections, lookups and remaps of example tables."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eospark.functions.storage import new_path


def need(df: DataFrame, *names: str) -> None:
    """Raise at once if columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}")


def filter_spec(df: DataFrame, spec) -> DataFrame:
    """``k=v`` (text), ``int:k=v``, ``bool:k=true``, ``key:a=b`` (two columns); empty keeps all; or a callable giving a Column."""
    if not spec:
        return df
    if callable(spec):
        return df.where(spec(df))
    head, eq, value = spec.partition("=")
    if not eq:
        raise ValueError(f"no = in filter {spec!r}")
    kind, colon, key = head.rpartition(":")
    need(df, key)
    if not colon:
        return df.where(F.col(key) == value)
    if kind == "key":
        need(df, value)
        return df.where(F.col(key) == F.col(value))
    if kind == "int":
        return df.where(F.col(key) == int(value))
    if kind == "bool":
        return df.where(F.col(key) == (value.lower() in ("true", "1")))
    raise ValueError(f"unknown kind of filter {kind!r}")


def keep(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.drop(*names)


def copy(df: DataFrame, inkey: str, outkey: str) -> DataFrame:
    need(df, inkey)
    return df.withColumn(outkey, F.col(inkey))


def rename(df: DataFrame, **names: str) -> DataFrame:
    need(df, *names)
    return df.withColumnsRenamed(names)


def flatten_keys(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*walk(df.schema, []))


def unflatten_keys(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns named by a path back into nested structs."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *path, leaf = name.split(sep)
        for p in path:
            at = at.setdefault(p, {})
        at[leaf] = F.col(f"`{name}`")

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def cast(df: DataFrame, key: str, dtype: str) -> DataFrame:
    """Cast; a value that does not fit raises under ANSI mode."""
    need(df, key)
    return df.withColumn(key, F.col(key).cast(dtype))


def invert_bool(df: DataFrame, *keys: str) -> DataFrame:
    """Logical not, in the column's own type."""
    need(df, *keys)
    return df.withColumns({k: (~F.col(k).cast("boolean")).cast(df.schema[k].dataType) for k in keys})


def setdefault(df: DataFrame, key: str, value) -> DataFrame:
    """An empty array becomes an array of one constant."""
    need(df, key)
    fill = F.array(F.lit(value)).cast(df.schema[key].dataType)
    return df.withColumn(key, F.when(F.size(key) > 0, F.col(key)).otherwise(fill))


def _is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def nonfinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def check_finite(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``column, n_bad``: rows with NaN or infinite values in each floating column, or in the given ones."""
    if keys:
        need(df, *keys)
    rows = []
    for f in df.schema.fields:
        if keys and f.name not in keys:
            continue
        array = isinstance(f.dataType, T.ArrayType) and _is_float(f.dataType.elementType)
        if array or _is_float(f.dataType):
            bad = F.exists(f.name, nonfinite) if array else nonfinite(F.col(f.name))
            rows.append(F.struct(F.lit(f.name).alias("column"), F.count(F.when(bad, 1)).alias("n_bad")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def ensure_finite(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; reading one with NaN or infinity in ``keys`` raises."""
    need(df, *keys)
    for k in keys:
        bad = F.exists(k, nonfinite) if isinstance(df.schema[k].dataType, T.ArrayType) else nonfinite(F.col(k))
        df = df.withColumn(k, F.when(bad, F.raise_error(F.lit(f"{k} is not finite"))).otherwise(F.col(k)))
    return df


def assert_sizes(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``column, n_bad``: rows whose arrays do not have the wanted number of elements."""
    need(df, *sizes)
    rows = [F.struct(F.lit(k).alias("column"), F.count(F.when(F.size(k) != n, 1)).alias("n_bad")) for k, n in sizes.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def lookup(df: DataFrame, dim: DataFrame, key: str, outkey: str, default: int = -1, max_broadcast: int = 1_000_000) -> DataFrame:
    """Text to integer by a table ``key, val``; what is missing gets ``default``. A small table is broadcast, after a count."""
    dim = dim.select(F.col("key").alias("_k"), F.col("val").alias("_v"))
    side = F.broadcast(dim) if dim.limit(max_broadcast + 1).count() <= max_broadcast else dim
    return df.join(side, df[key] == side["_k"], "left").withColumn(outkey, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def reverse_mapping(groups: dict[int, list]) -> dict:
    """``{value: [keys]}`` as ``{key: value}``; a key in two groups raises."""
    out: dict = {}
    for v, keys in groups.items():
        for k in keys:
            if k in out:
                raise ValueError(f"duplicate key {k!r}")
            out[k] = v
    return out


def remap(c: Column, mapping: dict | list, default: int = 0, is_array: bool = False) -> Column:
    """Values by a mapping (a list maps its indices); others get the default."""
    pairs = dict(enumerate(mapping)) if isinstance(mapping, list) else mapping
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    one = lambda x: F.coalesce(F.try_element_at(m, x), F.lit(default))
    return F.transform(c, one) if is_array else one(c)


def remap_ints(c: Column, mapping: list[int], is_array: bool = False) -> Column:
    """``mapping[x]``; an index out of range raises."""
    m = F.array(*[F.lit(x) for x in mapping])
    one = lambda x: F.element_at(m, (x + 1).cast("int"))
    return F.transform(c, one) if is_array else one(c)


def join_predictions(preds: DataFrame, labels: DataFrame, key: str = "id", check: bool = True) -> DataFrame:
    """Predictions and labels of one example; ids must be unique on both sides, which is checked before (``join_unique`` checks
    on the way)."""
    if check:
        for df in (preds, labels):
            if not df.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} is not unique")
    return preds.join(labels, key)


def join_unique(preds: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """The same as one lazy plan: an id that is not unique on its side fails the query when it runs.

    Rows are counted by id in the exchange that the join needs anyway; of tables saved by ``save_bucketed`` none is needed.
    """
    return _unique(preds, key).join(_unique(labels, key), key)


def _unique(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    fail = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))
    return one.where(F.when(F.col("_n") > 1, fail.isNotNull()).otherwise(True)).select(*df.columns)


def save_bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """``df`` written as a table whose files are bucketed and sorted by ``key``, and read back.

    Tables with equal ``buckets`` meet on the key, or are grouped by it, without an exchange, as often as they are read.
    """
    path = new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def literal(text: str):
    """A Python literal of the pipeline language; a bare word is text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text
