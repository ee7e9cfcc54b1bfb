"""Scalar expressions: transforms, distances, kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def clamp(c: Column, low: float | None, high: float | None) -> Column:
    """Null stays null; an absent limit does not bind."""
    out = c.cast("double")
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(float(low))))
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(float(high))))
    return out


def shifted_log(c: Column, shift: float) -> Column:
    """Natural logarithm of c + shift, null where that isn't positive."""
    x = c.cast("double") + F.lit(float(shift))
    return F.when(x > 0, F.log(x))


def yeo_johnson(c: Column, power: float) -> Column:
    x = c.cast("double")
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).when(x < 0, down)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its largest element."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """First place of the largest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def entropy(shares: Column) -> Column:
    return -F.aggregate(F.transform(shares, lambda p: p * F.log2(p + 1e-10)), F.lit(0.0), lambda a, x: a + x)


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric == "euclidean":
        return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return _fold(a, b, lambda x, y: F.abs(x - y))
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b) + EPSILON)
    raise ValueError(f"unknown metric {metric!r}")


def kernel(a: Column, b: Column, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> Column:
    if kind == "linear":
        return dot(a, b)
    if kind == "rbf":
        return F.exp(-gamma * _fold(a, b, lambda x, y: (x - y) * (x - y)))
    if kind == "poly":
        return F.pow(gamma * dot(a, b) + coef0, F.lit(float(degree)))
    if kind == "sigmoid":
        return F.tanh(gamma * dot(a, b) + coef0)
    raise ValueError(f"unknown kernel {kind!r}")


def item(name: str, c: Column, numeric: bool) -> Column:
    """Item of a basket: the bare name for 1 and true, ``name=value`` for other values, null for null, '' and 0."""
    text = c.cast("string")
    if numeric:
        return F.when(c.cast("double") == 1, F.lit(name)).when(c.cast("double") != 0, F.concat(F.lit(name + "="), text))
    return F.when(text == "true", F.lit(name)).when(~text.isin("", "false"), F.concat(F.lit(name + "="), text))


def shown(items: Column, sep: str = " & ") -> Column:
    return F.array_join(F.array_sort(items), sep)


def fixed(c: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))
