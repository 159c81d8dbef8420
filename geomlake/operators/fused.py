"""Distances to the last bit as DuckDB has them: products added one by one, each with a fused multiply-add.

Among tens of millions of distances some differ in their last bits alone, so an order of them is SQL's
only if every bit is. A matrix product adds in the same way on most machines, but not at its edges
and not for rows beyond some length. So products are taken in tiles of one shape, and a
process compares one tile of each length with additions one by one before it relies on them; where
they differ, it adds one by one itself, which takes some hundred times as long.
"""

from __future__ import annotations

import functools

import numpy as np

#: Rows of a tile on either side.
TILE = (16, 512)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def fma(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c, rounded once; no overflow or underflow on the way is provided for."""
    halves = lambda v: (h := (t := v * 134217729.0) - (t - v), v - h)
    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    u, ul = two_sum(c, ((ah * bh - p) + ah * bl + al * bh) + al * bl)
    t, tl = two_sum(p, u)
    v, error = two_sum(tl, ul)
    # Rounded to odd, so that the last addition rounds as if it had all bits.
    bits = v.view(np.int64)
    odd = (error != 0) & (bits & 1 == 0)
    return t + np.where(odd, bits + np.where((error > 0) == (v > 0), 1, -1), bits).view(np.float64)


def one_by_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products over the last axis."""
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for k in range(x.shape[-1]):
        total = fma(x[..., k], y[..., k], total)
    return total


@functools.cache
def tiles_agree(length: int) -> bool:
    """Whether a tile's matrix product of rows of a length has the bits of additions one by one."""
    rng = np.random.default_rng(length)
    x, y = (rng.standard_normal((n, length)) for n in TILE)
    return bool((x @ y.T == one_by_one(x[:, None], y)).all())


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of x with all of y."""
    (n, length), m = x.shape, len(y)
    if not tiles_agree(length):
        out = np.empty((n, m))
        for k in range(n):
            out[k] = one_by_one(x[k], y)
        return out
    padded = lambda v, step: v if len(v) % step == 0 else np.concatenate([v, np.zeros((-len(v) % step, length))])
    (a, b), x, y = TILE, padded(x, TILE[0]), padded(y, TILE[1])
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), a):
        for j in range(0, len(y), b):
            out[i : i + a, j : j + b] = x[i : i + a] @ y[j : j + b].T
    return out[:n, :m]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows less their mean and divided by their length; without variation: NaN."""
    mean = np.zeros(len(x))
    for column in x.T:
        mean += column
    y = x - (mean / max(1, x.shape[1]))[:, None]
    with np.errstate(invalid="ignore"):
        return y / np.sqrt(one_by_one(y, y))[:, None]


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation distances of rows that are unit(...) already; of rows without variation infinite, as SQL's NaN is last."""
    d = products(x, y)
    np.subtract(1, d, out=d)
    if np.isnan(x).any() or np.isnan(y).any():
        d[np.isnan(d)] = np.inf
    return d
