"""All-pairs geometry by blocks: a grid of id blocks, one matrix product for each pair of blocks.

A row travels to the block pairs that hold its block, so a task holds two blocks whatever the
table's size, and what leaves a task is only what the query needs: pairs, the k nearest of each
row in the block, or sums by group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; two blocks and their product fit a task easily.
BLOCK = 1024


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """vec_id, label, x with p, q, every block pair p >= q that holds the row's block, and whether it is p's."""
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.struct(F.greatest("own", m).alias("p"), F.least("own", m).alias("q")))
    return rows.select("vec_id", "label", "x", own.alias("own")).select("vec_id", "label", "x", "own", F.explode(mates).alias("m")).select("vec_id", "label", "x", "own", "m.p", "m.q")


def _over_blocks(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(ids, labels, x, ids', labels', x', same) of every pair of blocks; same: a block with itself."""
    n = max(1, -(-rows.count() // BLOCK))

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        x = np.array(table["x"].to_pylist(), float)
        first = table["own"].to_numpy() == table["p"].to_numpy()
        same = table["p"][0].as_py() == table["q"][0].as_py()
        other = first if same else ~first
        return kernel(ids[first], labels[first], x[first], ids[other], labels[other], x[other], same)

    return _dealt(rows, n).groupBy("p", "q").applyInArrow(run, schema)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation distances of rows."""
    unit = lambda m: (c := m - m.mean(axis=1, keepdims=True)) / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return 1 - unit(x) @ unit(y).T


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distances of rows."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return 1 - unit(x) @ unit(y).T


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0))


def pairs(rows: DataFrame, distance=correlation) -> DataFrame:
    """i, j, la, lb, d for all pairs i > j of rows (vec_id, label, x)."""

    def kernel(a, la, x, b, lb, y, same):
        i, j = np.nonzero(a[:, None] > b) if same else (m.ravel() for m in np.indices((len(a), len(b))))
        d = distance(x, y)[i, j] if len(a) and len(b) else np.zeros(0)
        swap = a[i] < b[j]
        high, low = np.where(swap, b[j], a[i]), np.where(swap, a[i], b[j])
        return pa.table({"i": high, "j": low, "la": np.where(swap, lb[j], la[i]), "lb": np.where(swap, la[i], lb[j]), "d": d})

    return _over_blocks(rows, kernel, "i long, j long, la int, lb int, d double")


def within(rows: DataFrame, measures: dict[str, Callable], full: bool = False) -> DataFrame:
    """label, i, j and the measures (functions of two matrices) of all pairs i > j of a label's rows.

    With full, all (i, j) of a label, both ways and with themselves. Labels are cut into blocks too.
    """
    n = max(1, -(-(rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0) // BLOCK))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, x = table["vec_id"].to_numpy(), np.array(table["x"].to_pylist(), float)
        first = table["own"].to_numpy() == table["p"].to_numpy()
        same = table["p"][0].as_py() == table["q"][0].as_py()
        other = first if same else ~first
        a, b = ids[first], ids[other]
        found = {name: f(x[first], x[other]) for name, f in measures.items()}
        if full:
            i, j = (m.ravel() for m in np.indices((len(a), len(b))))
            out = {"i": a[i], "j": b[j]} | {k: v[i, j] for k, v in found.items()}
            if not same:
                out = {k: np.concatenate([v, out[{"i": "j", "j": "i"}.get(k, k)]]) for k, v in out.items()}
        else:
            i, j = np.nonzero(a[:, None] > b) if same else (m.ravel() for m in np.indices((len(a), len(b))))
            out = {"i": np.maximum(a[i], b[j]), "j": np.minimum(a[i], b[j])} | {k: v[i, j] for k, v in found.items()}
        return pa.table({"label": np.full(len(out["i"]), table["label"][0].as_py(), np.int32)} | out)

    return _dealt(rows, n).groupBy("label", "p", "q").applyInArrow(run, "label int, i long, j long, " + ", ".join(f"{k} double" for k in measures))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def centred(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, x) less their label's mean: products of these are double-centred Grams."""
    at = rows.select("label", F.posexplode("x").alias("at", "v")).groupBy("label", "at").agg(F.avg("v").alias("m"))
    means = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda e: e["m"]).alias("_m"))
    return rows.join(means, "label").select("vec_id", "label", F.zip_with("x", "_m", lambda v, m: v - m).alias("x"))


def band(measure: Callable, first: int, last: int) -> Callable:
    """measure on the features from first (from 1) to last."""
    return lambda x, y: measure(x[:, first - 1 : last], y[:, first - 1 : last])


def nearest(rows: DataFrame, k: int, distance=correlation) -> DataFrame:
    """i, j, rk, d: the k nearest others of each row; a block gives at most k for each."""

    def best(a, d, b):
        d = np.where(a[:, None] == b, np.inf, d)
        order = np.lexsort((np.broadcast_to(b, d.shape), d), axis=1)[:, :k] if d.size else np.zeros((len(a), 0), int)
        i = np.repeat(np.arange(len(a)), order.shape[1])
        j = order.ravel()
        ok = np.isfinite(d[i, j]) if d.size else np.zeros(0, bool)
        return a[i][ok], b[j][ok], d[i, j][ok] if d.size else np.zeros(0)

    def kernel(a, la, x, b, lb, y, same):
        d = distance(x, y)
        found = [best(a, d, b)] + ([] if same else [best(b, d.T, a)])
        return pa.table(dict(zip(("i", "j", "d"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    w = Window.partitionBy("i").orderBy("d", "j")
    return _over_blocks(rows, kernel, "i long, j long, d double").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def nearest_within(rows: DataFrame, k: int, distance: Callable, itself: bool = False) -> DataFrame:
    """label, i, j, rk, d: each row's k nearest in its label by distance(x, y), which need not be symmetric."""
    n = max(1, -(-(rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0) // BLOCK))

    def run(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), np.array(table["x"].to_pylist(), float)
        first = table["own"].to_numpy() == table["p"].to_numpy()
        same = table["p"][0].as_py() == table["q"][0].as_py()
        out: list[tuple[np.ndarray, ...]] = []
        for mine, theirs in ((first, first),) if same else ((first, ~first), (~first, first)):
            if not mine.any() or not theirs.any():
                continue
            a, b, d = ids[mine], ids[theirs], distance(x[mine], x[theirs]).astype(float)
            if not itself:
                d = np.where(a[:, None] == b, np.inf, d)
            order = np.lexsort((np.broadcast_to(b, d.shape), d), axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
            ok = np.isfinite(d[i, j])
            out.append((a[i][ok], b[j][ok], d[i, j][ok]))
        i, j, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"label": pa.array(np.full(len(i), table["label"][0].as_py(), np.int32)), "i": i, "j": j, "d": d})

    found = _dealt(rows, n).groupBy("label", "p", "q").applyInArrow(run, "label int, i long, j long, d double")
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def group_means(rows: DataFrame, distance=euclidean) -> DataFrame:
    """i, label, other, m: each row's mean distance to the other rows of every label."""

    def sums(a, la, d, b, lb):
        d = np.where(a[:, None] == b, 0, d)
        names, place = np.unique(lb, return_inverse=True)
        onto = np.eye(len(names))[place]
        s, n = d @ onto, (a[:, None] != b) @ onto
        return np.repeat(a, len(names)), np.repeat(la, len(names)), np.tile(names, len(a)), s.ravel(), n.ravel()

    def kernel(a, la, x, b, lb, y, same):
        d = distance(x, y)
        found = [sums(a, la, d, b, lb)] + ([] if same else [sums(b, lb, d.T, a, la)])
        return pa.table(dict(zip(("i", "label", "other", "s", "n"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    out = _over_blocks(rows, kernel, "i long, label int, other int, s double, n double")
    return out.groupBy("i", "label", "other").agg((F.sum("s") / F.sum("n")).alias("m"))
