"""Cleaning of continuous signals (unit, run, k, value) and scalar functions on maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomlake.functions import special
from geomlake.functions import vectors as V

TINY = 1.1754943508222875e-38


def global_regression(rows: DataFrame) -> DataFrame:
    """Takes each TR's mean over all units away."""
    return rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("run", "k")))


def percent_change(rows: DataFrame, baseline: str | None = None) -> DataFrame:
    """Percent of the absolute baseline (a run's mean, or a column), 1 where that is near 0; NaN becomes 0."""
    m = F.col(baseline) if baseline else F.avg("value").over(Window.partitionBy("unit", "run"))
    mean = F.avg("value").over(Window.partitionBy("unit", "run"))
    size = F.when(F.abs(m) < 1e-6, 1.0).otherwise(F.abs(m))
    return rows.withColumn("value", F.nanvl((F.col("value") - mean) / size * 100, F.lit(0.0)))


def _table(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*map(F.lit, map(float, row))) for row in rows])


def high_pass(rows: DataFrame, window: int = 201, order: int = 3) -> DataFrame:
    """Takes the Savitzky-Golay smooth away, per unit and run; edges are the outer window's polynomial.

    The smooth is linear in the samples: place p of a window has fixed weights, and only at the
    edges p is not the middle. A run's samples are one array, bounded by the run's length.
    """
    half, weights = window // 2, F.broadcast(rows.sparkSession.createDataFrame([([list(map(float, r)) for r in special.savgol(window, order)],)], "weights array<array<double>>"))
    series = rows.groupBy("unit", "run").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s")).where(F.size("s") >= window).join(weights)
    start = lambda i: F.greatest(F.lit(0), F.least(i - half, F.size("s") - window))
    smooth = lambda i: V.dot(F.transform(F.slice("s", start(i) + 1, window), lambda e: e["value"]), F.get(F.col("weights"), i - start(i)))
    out = series.select("unit", "run", F.explode(F.transform("s", lambda e, i: F.struct(e["k"].alias("k"), (e["value"] - smooth(i)).alias("value")))).alias("e"))
    return out.select("unit", "run", "e.k", "e.value")


def convolved(rows: DataFrame, kernel: Sequence[float], *groups: str) -> DataFrame:
    """Causal convolution inside groups ordered by k (consecutive), as long as the input."""
    n = len(kernel)
    past = Window.partitionBy(*groups).orderBy("k").rowsBetween(-(n - 1), 0)
    held = rows.withColumn("_past", F.reverse(F.collect_list("value").over(past)))
    weights = F.array(*map(F.lit, map(float, kernel)))
    return held.withColumn("value", V.dot("_past", F.slice(weights, 1, F.size("_past")))).drop("_past")


def signed_log_p(p: Column, effect: Column) -> Column:
    """sign(effect) times -log10(p), p at least the smallest normal single-precision number."""
    return F.signum(effect) * -F.log10(F.greatest(p, F.lit(TINY)))


def fisher_z(r: Column, clip: float = 1e-6) -> Column:
    return F.atanh(F.greatest(F.lit(clip - 1), F.least(r, F.lit(1 - clip))))


def bivariate_key(x: Column, y: Column, bins: int, low: float, high: float) -> Column:
    """1 + y-bin times bins + x-bin of values clipped to [low, high]; 0 for NaN or null."""
    place = lambda v: F.least(F.floor((F.greatest(F.lit(low), F.least(v, F.lit(high))) - low) / (high - low) * bins), F.lit(bins - 1))
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)
    return F.when(bad, 0).otherwise(1 + place(y) * bins + place(x)).cast("int")


def balance(a: Column, b: Column) -> Column:
    return (a - b) / (F.abs(a) + F.abs(b) + 1e-8)


def joint(a: Column, b: Column) -> Column:
    """Geometric mean of the positive parts."""
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def hallucinated(text: Column) -> tuple[Column, Column]:
    """Word count, and whether at least 9 words make at most 2 distinct non-overlapping triples."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")), " "), lambda w: w != "")
    n = F.size(words)
    triples = F.transform(F.sequence(F.lit(0), n - 3, F.lit(3)), lambda i: F.concat_ws(" ", F.slice(words, i + 1, 3)))
    return n, F.when(n >= 9, F.size(F.array_distinct(triples)) <= 2).otherwise(False)
