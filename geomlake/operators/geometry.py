"""Representational geometry: searchlight, partial and cross-validated RSA, CKA and its decompositions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomlake.functions import ranks
from geomlake.operators import blocked


def crossnobis(pairs: DataFrame, *keys: str, delta: str = "delta") -> DataFrame:
    """Cross-validated squared distance per keys from each subject's and unit's difference of two conditions.

    (|sum over subjects|^2 - sum of |each|^2) / (N (N - 1)): two aggregations, no pairs of subjects.
    """
    per_unit = pairs.groupBy(*keys, "unit").agg(F.sum(delta).alias("s"), F.sum(F.col(delta) * F.col(delta)).alias("q"), F.count(F.lit(1)).alias("n"))
    return per_unit.groupBy(*keys).agg((F.sum((F.col("s") * F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1)))).alias("d"), F.max("n").alias("n"))


def noise_ceiling(distances: DataFrame, *keys: str) -> DataFrame:
    """upper, lower per keys: mean over subjects of the correlation with the mean of all, or of the other, subjects.

    distances: subject, keys, pair, d. The mean of the others is (N mean - d) / (N - 1), so no self-join.
    """
    w = Window.partitionBy(*keys, "pair")
    held = distances.withColumns({"m": F.avg("d").over(w), "n": F.count("d").over(w)})
    held = held.withColumn("loo", (F.col("n") * F.col("m") - F.col("d")) / (F.col("n") - 1))
    each = held.groupBy(*keys, "subject").agg(F.corr("d", "m").alias("up"), F.corr("d", "loo").alias("lo"))
    return each.groupBy(*keys).agg(F.avg("up").alias("upper"), F.avg("lo").alias("lower"), F.count(F.lit(1)).alias("n"))


def partial_2(y: str, x: str, z1: str, z2: str, corr: Callable[[str, str], Column] = F.corr) -> Column:
    """Correlation of y and x with both z taken out of both, by recursion over correlations: an aggregate, unless corr gives columns."""
    p = lambda a, b, c: ranks.partial(corr(a, b), corr(a, c), corr(b, c))
    return ranks.partial(p(y, x, z1), p(y, z2, z1), p(x, z2, z1))


def centred_gram(gram: DataFrame, *keys: str) -> DataFrame:
    """Double centring of gram (keys, i, j, k), all i and j present: k less row and column means plus the mean."""
    mean = lambda *by: F.avg("k").over(Window.partitionBy(*keys, *by) if keys or by else Window.partitionBy(F.lit(0)))
    total = gram.groupBy(*keys).agg(F.avg("k").alias("all_mean"))
    held = gram.join(F.broadcast(total), list(keys)) if keys else gram.crossJoin(F.broadcast(total))
    return held.withColumn("k", F.col("k") - mean("i") - mean("j") + F.col("all_mean")).drop("all_mean")


def cosine(a: str, b: str) -> Column:
    """Aggregate: cosine of two columns, 0 without variation."""
    norm = F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
    return F.when(norm > 1e-12, F.sum(F.col(a) * F.col(b)) / norm).otherwise(0.0)


def semipartial(cos: dict[str, Column], own: dict[tuple[str, str], Column], target: str, others: tuple[str, str]) -> Column:
    """Correlation of the data with what of the target neither other component spans (2 by 2 inverse).

    cos: the data's cosine with each component; own: components' cosines with one another.
    """
    a, b = others
    g = lambda p, q: own.get((p, q), own.get((q, p)))
    det = 1 - g(a, b) * g(a, b)
    wa, wb = (g(target, a) - g(a, b) * g(target, b)) / det, (g(target, b) - g(a, b) * g(target, a)) / det
    rest = 1 - wa * g(target, a) - wb * g(target, b)
    return F.when(rest > 1e-12, (cos[target] - wa * cos[a] - wb * cos[b]) / F.sqrt(rest)).otherwise(0.0)


def r2_two(ca: Column, cb: Column, g: Column) -> Column:
    """c' R^-1 c of two components with correlation g."""
    return (ca * ca + cb * cb - 2 * ca * cb * g) / (1 - g * g)


def r2_three(c: list[Column], g12: Column, g13: Column, g23: Column) -> Column:
    """c' R^-1 c of three components, by the adjugate."""
    det = 1 + 2 * g12 * g13 * g23 - g12 * g12 - g13 * g13 - g23 * g23
    x, y, z = c
    quad = x * x * (1 - g23 * g23) + y * y * (1 - g13 * g13) + z * z * (1 - g12 * g12)
    cross = x * y * (g13 * g23 - g12) + x * z * (g12 * g23 - g13) + y * z * (g12 * g13 - g23)
    return (quad + 2 * cross) / det


REGIONS = ("unique_a", "unique_v", "unique_j", "shared_av_only", "shared_aj", "shared_vj", "shared_avj")


def partition(r: dict[str, Column]) -> dict[str, Column]:
    """The seven disjoint regions of a, v, j from the R² of all seven subsets; they add up to avj's."""
    a, v, j, av, aj, vj, full = (r[k] for k in ("a", "v", "j", "av", "aj", "vj", "avj"))
    return dict(zip(REGIONS, (full - vj, full - aj, full - av, aj + vj - j - full, av + vj - v - full, av + aj - a - full, a + v + j - av - aj - vj + full), strict=True))


def searchlight_cka(patterns: DataFrame, neighbours: dict[int, list[int]], seed_features: list[int]) -> DataFrame:
    """label, centre, value: cosine of each neighbourhood's column-centred Gram with the seed features'.

    The inner product of two Grams of rows is the sum of squares of their features' cross products, so a
    label is summed up to features by features, and no matrix of its rows is built. Under 2 features: 0.
    """
    kind = dict(patterns.dtypes)["label"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                labels, x = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), np.float64)
                for label in set(labels.tolist()):
                    here = x[labels == label]
                    held[label] = held.get(label, 0) + here.T @ here
        for label, total in held.items():
            i, j = np.divmod(np.arange(total.size, dtype=np.int32), len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, label, np.int32)), pa.array(i), pa.array(j), pa.array(total.ravel())], ["label", "i", "j", "s"])

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        c = np.zeros((i.max() + 1, i.max() + 1))
        c[i, j] = table["s"].to_numpy()
        norm = lambda a, b: float((c[np.ix_(a, b)] ** 2).sum())
        own, centres, values = norm(seed_features, seed_features), sorted(neighbours), []
        for centre in centres:
            near = neighbours[centre]
            base = np.sqrt(norm(near, near)) * np.sqrt(own)
            values.append(norm(near, seed_features) / base if len(near) >= 2 and base > 1e-24 else 0.0)
        return pa.table({"label": pa.array([table["label"][0].as_py()] * len(values), pa.int32()), "centre": pa.array(centres, pa.int32()), "value": values})

    sums = blocked.centred(patterns).select("label", "x").mapInArrow(add, f"label {kind}, i int, j int, s double")
    return sums.groupBy("label", "i", "j").agg(F.sum("s").alias("s")).groupBy("label").applyInArrow(run, "label int, centre int, value double")


def band_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """X'X of a partition's rows (array x), one row each of the matrix: partial sums to be added up."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        n = len(total)
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])


def cross_products(rows: DataFrame, x: str = "x") -> DataFrame:
    """i, j, s: X'X over all rows, by partial products; its size is the number of features squared."""
    return rows.select(x).mapInArrow(band_gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
