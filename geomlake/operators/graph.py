"""Mesh and graph operators: adjacency, components, borders, cores, geodesic neighbours, region growing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomlake.sources import store


def edges_of_faces(faces: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """src, dst of triangles (a, b, c): both directions, once each, restricted to valid vertices (vertex)."""
    corners = [("a", "b"), ("b", "c"), ("c", "a")]
    pairs = F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for x, y in corners for p, q in ((x, y), (y, x))])
    edges = faces.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()
    for end in ("src", "dst") if valid is not None else ():
        edges = edges.join(valid.select(F.col("vertex").alias(end)), end, "left_semi")
    return edges.select("src", "dst")


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """vertex, label: the smallest vertex of its component, by label propagation with pointer jumping.

    Each round is stored in the shared folder, so lineage stays short and an executor may be lost.
    """
    labels = vertices.select("vertex", F.col("vertex").alias("label"))
    edges = edges.join(vertices.select(F.col("vertex").alias("src")), "src", "left_semi").join(vertices.select(F.col("vertex").alias("dst")), "dst", "left_semi")
    edges = store.stored(edges.select("src", "dst"), "edges")
    for _ in range(rounds):
        low = edges.join(labels.toDF("dst", "near"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("near").alias("near"))
        best = labels.join(low, "vertex", "left").select("vertex", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = best.join(labels.toDF("label", "over"), "label").select("vertex", "old", F.least("label", "over").alias("label"))
        step = store.stored(step, "labels")
        labels = step.select("vertex", "label")
        if step.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")


def kept_clusters(labels: DataFrame, least: int) -> DataFrame:
    """vertex, label of components with at least `least` vertices."""
    return labels.join(labels.groupBy("label").count().where(F.col("count") >= least).select("label"), "label", "left_semi").select("vertex", "label")


def borders(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex of the mask with a neighbour outside it."""
    inside = mask.select(F.col("vertex").alias("src"))
    outside = edges.join(mask.select(F.col("vertex").alias("dst")), "dst", "left_anti")
    return inside.join(outside.select("src"), "src", "left_semi").toDF("vertex")


def k_core(vertices: DataFrame, edges: DataFrame, least: int, rounds: int = 1000) -> DataFrame:
    """vertex: what remains when vertices of a degree below `least` are taken away again and again."""
    kept, n = vertices.select("vertex"), None
    for _ in range(rounds):
        alive = edges.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi")
        kept = store.stored(alive.groupBy(F.col("src").alias("vertex")).count().where(F.col("count") >= least).select("vertex"), "core")
        now = kept.count()
        if now == n:
            return kept
        n = now
    raise RuntimeError("the core did not settle")


def voxel_edges(voxels: DataFrame) -> DataFrame:
    """src, dst, w of voxels (vertex, i, j, k) that touch by a face, an edge or a corner: equi-joins on shifted cells."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    moved = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("k") + c).alias("k"), F.lit(float(a * a + b * b + c * c) ** 0.5).alias("w")) for a, b, c in steps])
    near = voxels.select(F.col("vertex").alias("src"), F.explode(moved).alias("n")).select("src", "n.*")
    return near.join(voxels.withColumnRenamed("vertex", "dst"), ["i", "j", "k"]).select("src", "dst", "w")


def geodesic_knn(edges: DataFrame, group: str, k: int, places: DataFrame | None = None) -> DataFrame:
    """group, src, rk, dst, dist: the k nearest along weighted edges (group, src, dst, w), by Dijkstra per group.

    With places (group, vertex, x), a vertex that reaches fewer than k others is filled up by the nearest in
    space of those that it doesn't reach, with a null dist; a vertex without edges has them all so.
    """

    def search(part: pd.DataFrame, at: pd.DataFrame | None = None) -> pd.DataFrame:
        near: dict[int, list[tuple[float, int]]] = {}
        for s, d, w in zip(part["src"], part["dst"], part["w"], strict=True):
            near.setdefault(int(s), []).append((float(w), int(d)))
        held = {} if at is None else {int(v): np.array(x, float) for v, x in zip(at["vertex"], at["x"], strict=True)}
        name, out = (part if len(part) else at)[group].iloc[0], []
        for source in sorted({*near, *held}):
            done, queue = {}, [(0.0, source)]
            while queue and len(done) <= k:
                dist, v = heapq.heappop(queue)
                if v in done:
                    continue
                done[v] = dist
                for w, u in near.get(v, ()):
                    if u not in done:
                        heapq.heappush(queue, (round(dist + w, 9), u))
            found: list[tuple[float | None, int]] = sorted((d, v) for v, d in done.items() if v != source)[:k]
            if len(found) < k and held:
                rest = sorted((round(float(((held[v] - held[source]) ** 2).sum()), 9), v) for v in held if v not in done)
                found += [(None, v) for _, v in rest[: k - len(found)]]
            out += [(name, source, r, v, d) for r, (d, v) in enumerate(found, 1)]
        return pd.DataFrame(out, columns=[group, "src", "rk", "dst", "dist"])

    schema = f"{group} {dict(edges.dtypes)[group]}, src int, rk int, dst int, dist double"
    if places is None:
        return edges.groupBy(group).applyInPandas(lambda part: search(part), schema)
    held = places.select(F.col(group).alias("_of"), "vertex", "x").groupBy("_of")
    return edges.groupBy(group).cogroup(held).applyInPandas(lambda part, at: search(part, at.rename(columns={"_of": group})), schema)


def grown_regions(values: np.ndarray, near: list[list[int]], seeds: list[list[int]], fraction: float, degree: int = 0, apart: bool = False) -> list[list[int]]:
    """From each seed set's peak: the vertices connected with it that lie above `fraction` of its value.

    With a degree, vertices with fewer neighbours in the region are taken away again and again, and what
    is still connected with the peak stays; nothing, if the peak itself goes. With `apart`, regions that
    share a vertex are an error.
    """

    def connected(allowed: set[int], peak: int) -> set[int]:
        region, queue = set(), [peak] if peak in allowed else []
        while queue:
            v = queue.pop()
            if v not in region:
                region.add(v)
                queue += [u for u in near[v] if u in allowed and u not in region]
        return region

    peaks = [max(seed, key=lambda v: (values[v], -v)) for seed in seeds]
    raw = [connected({int(v) for v in np.flatnonzero(values > fraction * values[p])}, p) for p in peaks]
    if apart and len(set().union(*raw)) < sum(map(len, raw)):
        raise ValueError("regions overlap: take a larger fraction")
    out = []
    for peak, region in zip(peaks, raw, strict=True):
        while weak := {v for v in region if sum(u in region for u in near[v]) < degree}:
            region = region - weak
        out.append(sorted(connected(region, peak)))
    return out


def merge_saddle(values: np.ndarray, near: list[list[int]], a: int, b: int) -> float:
    """The highest threshold at which a and b lie in one region above it; -inf if never."""
    top, order = {}, np.argsort(-values, kind="stable")

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for v in order.tolist():
        top[v] = v
        for u in near[v]:
            if u in top:
                top[find(u)] = find(v)
        if a in top and b in top and find(a) == find(b):
            return float(values[v])
    return -np.inf


def contour(mask: DataFrame, edges: DataFrame, n_vertices: int, most: float = 0.9) -> DataFrame:
    """src, dst of edges from the mask outwards: its border; none for an empty mask or one that covers more than `most`."""
    fits = mask.agg(F.count(F.lit(1)).alias("n")).where(f"n > 0 AND n <= {most * n_vertices}")
    crossing = edges.join(mask.select(F.col("vertex").alias("src")), "src", "left_semi").join(mask.select(F.col("vertex").alias("dst")), "dst", "left_anti")
    return crossing.join(F.broadcast(fits)).select("src", "dst")  # one row
