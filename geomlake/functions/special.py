"""Distribution functions without SciPy, for Arrow-batched UDFs and tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    if not math.isfinite(t) or df <= 0:
        return math.nan if math.isnan(t) or df <= 0 else float(t < 0)
    half = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """One-sided Fisher exact p of at least a in [[a, b], [c, d]]."""
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    row, column, n = a + b, a + c, a + b + c + d
    logs = [log_choose(row, k) + log_choose(n - row, column - k) - log_choose(n, column) for k in range(a, min(row, column) + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def t_upper_p(t: Column, df: Column) -> Column:
    """P(T > t), by Arrow batches."""

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([math.nan if pd.isna(x) or pd.isna(d) else t_sf(float(x), float(d)) for x, d in zip(t, df, strict=True)], dtype=float)

    return F.pandas_udf(p, "double")(t, df)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided Fisher exact p of a 2 by 2 table, by Arrow batches."""

    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_tail(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)

    return F.pandas_udf(p, "double")(a, b, c, d)


def hrf(tr: float = 1.0, length: float = 32.0, peak: float = 6.0, under: float = 16.0, ratio: float = 1 / 6) -> np.ndarray:
    """Difference of two gamma densities at multiples of tr, with sum 1."""
    t = np.arange(0, length, tr)
    density = lambda shape: np.where(t > 0, t ** (shape - 1) * np.exp(-t) / math.gamma(shape), 0.0)
    kernel = density(peak) - ratio * density(under)
    return kernel / kernel.sum()


def savgol(window: int, order: int) -> np.ndarray:
    """Row p: the weights of a window's values in its polynomial fit's value at place p."""
    at = np.arange(window) - window // 2
    powers = np.vander(at, order + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def inversions(y: np.ndarray) -> int:
    """How many pairs of places have the larger number first; y: whole numbers from 0. Bit by bit, from the highest."""
    found, y = 0, y.astype(np.int64)
    for bit in range(int(y.max()).bit_length() - 1 if len(y) else -1, -1, -1):
        # Numbers equal in the higher bits lie together, in their first order.
        one = y >> bit & 1
        starts = np.flatnonzero(np.concatenate([[True], np.diff(y >> (bit + 1)) != 0]))
        size = np.diff(np.append(starts, len(y)))
        ones = np.cumsum(one)
        before = ones - np.repeat(ones[starts] - one[starts], size)
        found += int(before[one == 0].sum())
        start, zeros = np.repeat(starts, size), np.repeat(size - np.add.reduceat(one, starts), size)
        moved = np.empty_like(y)
        moved[np.where(one == 1, start + zeros + before - 1, np.arange(len(y)) - before)] = y
        y = moved
    return found


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in n log n: sort by x, count the inversions of y."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    tied_x, tied_y = (pairs(np.unique(v, return_counts=True)[1]) for v in (x, y))
    tied_both = pairs(np.unique(np.stack([np.unique(x, return_inverse=True)[1], y]), axis=1, return_counts=True)[1])
    swaps = inversions(y)
    total = n * (n - 1) // 2
    base = math.sqrt(float(total - tied_x) * float(total - tied_y))
    return (total - tied_x - tied_y + tied_both - 2 * swaps) / base if base else math.nan
