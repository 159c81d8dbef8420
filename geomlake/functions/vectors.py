"""Vector arithmetic on ARRAY<DOUBLE> columns with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, not once per element of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def doubles(a) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return total(a) / F.size(a)


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(a, lambda x: x * f))


def centred(a) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def unit(a) -> Column:
    """a over its norm; zeros if the norm is 0."""
    return let(F.sqrt(dot(a, a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def zscore(a) -> Column:
    """Population z-score; a constant vector becomes zeros."""
    return let(centred(a), lambda c: scaled(c, F.when(dot(c, c) > 0, F.sqrt(F.size(c) / dot(c, c))).otherwise(0.0)))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def projection_residual(t, a, v, eps: float = 1e-8) -> Column:
    """t less its projection on the span of a and v, by orthogonalizing v against a."""
    along = lambda x, e: scaled(e, dot(x, e) / F.greatest(dot(e, e), F.lit(eps)))
    return let(minus(v, along(v, a)), lambda w: let(minus(t, along(t, a)), lambda r: minus(r, along(r, w))))


def r6(x) -> Column:
    """Six decimals, without a negative zero: engines differ in the last bits of sums."""
    return F.round(x, 6) + F.lit(0.0)


def near6(x) -> Column:
    """Six decimals of values that may be exact halves of the sixth: nudged, so that engines agree."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1.7e-10), 6) + F.lit(0.0)
