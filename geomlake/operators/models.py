"""Modelling on DataFrames: folds, ridge, reductions, clusterings; kernels run per group or target batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomlake.operators import geometry, kernels


def folds(rows: DataFrame, unit: str) -> DataFrame:
    """rows once for each held-out unit: fold, is_test. The units (runs or clips) are few."""
    names = rows.select(F.col(unit).alias("fold")).distinct()
    return rows.join(F.broadcast(names)).withColumn("is_test", F.col(unit) == F.col("fold"))


def ridge(rows: DataFrame, x: str, y: str, penalty: float) -> np.ndarray:
    """Weights (and the intercept last) of y on array x: the cross products are aggregated, the system is small."""
    held = rows.select(F.concat(x, F.array(F.col(y), F.lit(1.0))).alias("x"))
    s = geometry.cross_products(held).toPandas()
    d = int(s["i"].max()) + 1
    m = np.zeros((d, d))
    m[s["i"], s["j"]] = s["s"]
    n, mean, my = m[-1, -1], m[:-2, -1] / m[-1, -1], m[-2, -1] / m[-1, -1]
    w = np.linalg.solve(m[:-2, :-2] - n * np.outer(mean, mean) + penalty * np.eye(d - 2), m[:-2, -2] - n * mean * my)
    return np.append(w, my - mean @ w)


def explained_variance(rows: DataFrame, x: str) -> np.ndarray:
    """Shares of variance of the principal components, from one pass of cross products."""
    s = geometry.cross_products(rows.select(F.concat(x, F.array(F.lit(1.0))).alias("x"))).toPandas()
    d = int(s["i"].max()) + 1
    m = np.zeros((d, d))
    m[s["i"], s["j"]] = s["s"]
    mean = m[:-1, -1] / m[-1, -1]
    values = np.linalg.eigvalsh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[::-1]
    return np.maximum(values, 0) / np.maximum(values, 0).sum()


def components(rows: DataFrame, x: str, k: int, train: str | None = None) -> np.ndarray:
    """The k first principal axes of the rows (of the training rows, if a column marks them), signs fixed."""
    held = rows.where(F.col(train)) if train else rows
    s = geometry.cross_products(held.select(F.concat(x, F.array(F.lit(1.0))).alias("x"))).toPandas()
    d = int(s["i"].max()) + 1
    m = np.zeros((d, d))
    m[s["i"], s["j"]] = s["s"]
    mean = m[:-1, -1] / m[-1, -1]
    axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[1][:, ::-1][:, :k]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])


def ica(rows: DataFrame, x: str, k: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (features by k) of the independent components, (x - mean) @ axes, fitted on all rows.

    As kernels.fast_ica: the rows are whitened by their k first principal components, and each step
    is a pass that adds up k by k moments over all rows.
    """
    s = geometry.cross_products(rows.select(F.concat(x, F.array(F.lit(1.0))).alias("x"))).toPandas()
    d = int(s["i"].max()) + 1
    m = np.zeros((d, d))
    m[s["i"], s["j"]] = s["s"]
    n, mean = m[-1, -1], m[:-1, -1] / m[-1, -1]
    values, vectors = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    white = vectors[:, ::-1][:, :k]
    white = white * np.sign(white[np.abs(white).argmax(axis=0), np.arange(k)]) / np.sqrt(np.maximum(values[::-1][:k], 1e-12))

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k + k)
            for batch in batches:
                if batch.num_rows:
                    z = (batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) - mean) @ white
                    g = np.tanh(z @ w.T)
                    total += np.append((g.T @ z).ravel(), (1 - g * g).sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

        found = rows.select(F.col(x).alias("x")).mapInArrow(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy() / n
        return found[: k * k].reshape(k, k), found[k * k :]

    w = np.linalg.qr(np.eye(k) + 0.1 * np.sin(np.arange(k * k)).reshape(k, k))[0]
    for _ in range(steps):
        gz, slope = moments(w)
        a, _, b = np.linalg.svd(gz - np.diag(slope) @ w)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return mean, white @ w.T


def banded_ridge(design: dict[str, np.ndarray], groups: np.ndarray, targets: DataFrame, n_draws: int = 20, penalties: np.ndarray | None = None, scale: bool = False) -> DataFrame:
    """target, subset, r2: held-out R² of every target for all subsets of the bands, leaving one group out.

    Features are centred, and with `scale` standardized, by the training rows.

    design: a matrix for each band, rows by window (broadcast: its size is windows by features).
    targets: target, y (array over the windows). Targets are independent, so partitions of them are
    fitted side by side; inner folds leave one of the remaining groups out.
    """
    penalties = np.logspace(-2, 9, 23) if penalties is None else penalties
    names = sorted(design)
    subsets = [[n for k, n in enumerate(names) if code >> k & 1] for code in range(1, 1 << len(names))]
    shared = targets.sparkSession.sparkContext.broadcast((design, groups))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, fold = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.array(batch.column(1).to_pylist(), float).T
            for subset in subsets:
                guess = np.zeros_like(y)
                for held in np.unique(fold):
                    train, test = fold != held, fold == held
                    means = [bands[b][train].mean(axis=0) for b in subset]
                    spreads = [np.maximum(bands[b][train].std(axis=0), 1e-12) if scale else 1.0 for b in subset]
                    xs = [(bands[b][train] - m) / s for b, m, s in zip(subset, means, spreads, strict=True)]
                    new = [(bands[b][test] - m) / s for b, m, s in zip(subset, means, spreads, strict=True)]
                    draws = kernels.band_draws(n_draws if len(subset) > 1 else 1, len(subset))
                    best, _ = kernels.ridge_path(xs, y[train], fold[train], draws, penalties)
                    for d, p in np.unique(best, axis=0):
                        chosen = (best == (d, p)).all(axis=1)
                        guess[np.ix_(test, chosen)] = kernels.ridge_predict(xs, y[train][:, chosen], new, draws[d], penalties[p])
                sst = ((y - y.mean(axis=0)) ** 2).sum(axis=0)
                r2 = np.where(sst > 1e-12, 1 - ((y - guess) ** 2).sum(axis=0) / np.maximum(sst, 1e-12), np.nan)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(subset)] * len(r2)), pa.array(r2)], ["target", "subset", "r2"])

    kind = dict(targets.dtypes)["target"]
    return targets.select("target", "y").mapInArrow(fit, f"target {kind}, subset string, r2 double")


def per_group(rows: DataFrame, group: str, kernel, schema: str) -> DataFrame:
    """kernel(ids, matrix) of each group's rows (vec_id, x), as a DataFrame of schema after the group.

    Kernels hold a group's rows and a few numbers for each, not its pairs.
    """
    kind = dict(rows.dtypes)[group]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        out = kernel(part["vec_id"].to_numpy(), np.stack(part["x"]).astype(float))
        out.insert(0, group, part[group].iloc[0])
        return out

    return rows.select(group, "vec_id", "x").groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}")


def landmark_extension(landmarks: np.ndarray, coordinates: np.ndarray, rows: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, y: each row's coordinates, the distance-weighted mean of its k nearest landmarks' (a bounded table)."""
    shared = rows.sparkSession.sparkContext.broadcast((landmarks, coordinates))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, places = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (marks * marks).sum(1) - 2 * x @ marks.T, 0))
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                w = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-9)
                y = (places[near] * w[:, :, None]).sum(axis=1) / w.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y))], ["vec_id", "y"])

    return rows.select("vec_id", "x").mapInArrow(extend, "vec_id long, y array<double>")


def linear_residual(rows: DataFrame, target: str, source: str, eps: float = 1e-6) -> np.ndarray:
    """The map B with target - source B as small as can be: cross products by aggregation, the solution on the driver."""
    a = len(rows.select(source).first()[0])
    s = geometry.cross_products(rows.select(F.concat(source, target).alias("x"))).toPandas()
    d = int(s["i"].max()) + 1
    m = np.zeros((d, d))
    m[s["i"], s["j"]] = s["s"]
    return np.linalg.solve(m[:a, :a] + eps * np.eye(a), m[:a, a:])
