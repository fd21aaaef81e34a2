"""Column expressions on arrays of numbers, and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def u(key: Column, salt: str | Column) -> Column:
    """A portable uniform number in [0, 1) for a row: the same in any engine and for any partitioning."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    text = F.concat(key.cast("string"), F.lit(":"), salt)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def div0(a: Column, b: Column) -> Column:
    """a / b, where 0 / 0 is 0 and anything else over 0 is infinite with the sign of ``a``."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, 0.0).otherwise(F.signum(a) * F.lit(float("inf")))


def div_nan(a: Column, b: Column) -> Column:
    """a / b, and NaN over 0."""
    return F.when(b != 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(F.lit(NAN))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(xs) / F.size(xs)


def log_sum_exp(xs: Column) -> Column:
    m = F.array_max(xs)
    return m + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def softmax(xs: Column) -> Column:
    z = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - z))


def log_softmax(xs: Column) -> Column:
    z = log_sum_exp(xs)
    return F.transform(xs, lambda x: x - z)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))), without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def argmax(xs: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def one_hot(label: Column, n: int, smoothing: float = 0.0) -> Column:
    """Soft targets of an integer label; smoothing is spread evenly over the other classes. A label out of range is none."""
    low = smoothing / (n - 1) if smoothing else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1.0 - smoothing).otherwise(low))


def digitize(x: Column, edges: list[float]) -> Column:
    """How many edges are at or below x."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))
