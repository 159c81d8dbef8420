"""NumPy kernels of solvers that no Spark operator covers; each runs inside one task on a bounded group."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd


def ridge_path(bands: list[np.ndarray], y: np.ndarray, folds: np.ndarray, draws: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Banded ridge: for each target the draw (band weights) and penalty with the best inner score.

    bands: row-aligned design matrices; folds: inner fold of each row; draws: weights of the bands,
    one row each. Uses the eigenvectors of the weighted kernel, so all penalties cost one
    decomposition. Returns, per target, the place in (draw, penalty) and the score.
    """
    n_targets = y.shape[1]
    best, score = np.zeros((n_targets, 2), int), np.full(n_targets, -np.inf)
    kernels = [b @ b.T for b in bands]
    for d, weights in enumerate(draws):
        kernel = sum(w * k for w, k in zip(weights, kernels, strict=True))
        total = np.zeros((len(penalties), n_targets))
        for fold in np.unique(folds):
            test, train = folds == fold, folds != fold
            values, vectors = np.linalg.eigh(kernel[np.ix_(train, train)])
            mean = y[train].mean(axis=0)
            projected, cross = vectors.T @ (y[train] - mean), kernel[np.ix_(test, train)] @ vectors
            sst = ((y[test] - y[test].mean(axis=0)) ** 2).sum(axis=0)
            for p, penalty in enumerate(penalties):
                guess = cross @ (projected / (np.maximum(values, 0) + penalty)[:, None]) + mean
                total[p] += 1 - ((y[test] - guess) ** 2).sum(axis=0) / np.maximum(sst, 1e-12)
        for p in range(len(penalties)):
            better = total[p] > score
            score[better], best[better] = total[p][better], (d, p)
    return best, score / len(np.unique(folds))


def ridge_predict(bands: list[np.ndarray], y: np.ndarray, new: list[np.ndarray], weights: np.ndarray, penalty: float) -> np.ndarray:
    kernel = sum(w * b @ b.T for w, b in zip(weights, bands, strict=True))
    cross = sum(w * c @ b.T for w, b, c in zip(weights, bands, new, strict=True))
    mean = y.mean(axis=0)
    return cross @ np.linalg.solve(kernel + penalty * np.eye(len(y)), y - mean) + mean


def band_draws(n: int, n_bands: int) -> np.ndarray:
    """Band weights with sum 1, reproducible without a generator's version: the equal split, then a Halton walk."""
    primes = (2, 3, 5, 7, 11, 13)
    halton = lambda i, b: sum((i // b**k % b) / b ** (k + 1) for k in range(24))
    raw = np.array([[1.0] * n_bands] + [[-math.log(max(halton(i, primes[b]), 1e-6)) for b in range(n_bands)] for i in range(1, n)])
    return raw / raw.sum(axis=1, keepdims=True)


def ward(x: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of Ward linkage; new clusters are numbered from n.

    By chains of nearest neighbours over the clusters' means: the distances of one cluster are held, not all.
    """
    n = len(x)
    c, size, out = x - x.mean(axis=0) if n else x.copy(), np.ones(n), []
    square, alive, low = (c * c).sum(axis=1), np.ones(n, bool), np.zeros(n)
    chain, chained = [], np.zeros(n, bool)
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
            chained[chain[0]] = True
        a = chain[-1]
        d = np.where(alive, np.maximum(square + square[a] - 2 * (c @ c[a]), 0) * (2 * size[a] * size / (size[a] + size)), np.inf)
        d[a] = np.inf
        b = int(np.argmin(d))
        # Ties go back along the chain, which else might go round.
        if len(chain) > 1 and (d[chain[-2]] <= d[b] or chained[b]):
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            chained[b] = True
            continue
        chained[chain[-2:]] = False
        del chain[-2:]
        height = max(d[b], low[a], low[b])
        out.append((height, a, b))
        a, b = min(a, b), max(a, b)
        c[a] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
        square[a], low[a], alive[b] = c[a] @ c[a], height, False
        size[a] += size[b]
    top, name, members, merges = list(range(n)), list(range(n)), [1] * n, []

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for step, (height, a, b) in enumerate(sorted(out, key=lambda m: m[0])):
        a, b = find(a), find(b)
        members[a] += members[b]
        merges.append((min(name[a], name[b]), max(name[a], name[b]), math.sqrt(height), members[a]))
        top[b], name[a] = a, n + step
    return np.array(merges, float).reshape(-1, 4)


def leaves(node: int, n: int, halves) -> list[int]:
    """The rows below a node; halves(node): its two parts."""
    found, stack = [], [node]
    while stack:
        v = stack.pop()
        if v < n:
            found.append(v)
        else:
            stack += map(int, halves(v))
    return found


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of k clusters, numbered by their smallest member."""
    top = list(range(2 * n - 1))

    def find(v: int) -> int:
        while top[v] != v:
            v = top[v]
        return v

    for step, (a, b, *_) in enumerate(merges[: n - k]):
        top[find(int(a))] = top[find(int(b))] = n + step
    roots = [find(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def selective_clusters(merges: np.ndarray, score, n: int, low: int, high: int) -> list[list[int]]:
    """A flat partition of n rows by their dendrogram and a score of member lists, from the root down.

    A half that scores below its node ends there; a node both of whose halves do stays whole. Lists of
    fewer than `low` or more than `high` members score lowest.
    """
    members = lambda node: leaves(node, n, lambda v: merges[v - n][:2])
    size = lambda node: merges[node - n][3] if node >= n else 1
    value = lambda node: score(members(node)) if low <= size(node) <= high else -math.inf
    ends, open_ = [], [n + len(merges) - 1] if n else []
    while open_:
        node = open_.pop()
        halves = [int(v) for v in merges[node - n][:2]] if node >= n else []
        own = value(node) if halves else 0.0
        falling = [value(h) < own for h in halves]
        if all(falling):
            ends.append(node)
            continue
        for half, falls in zip(halves, falling, strict=True):
            (ends if falls else open_).append(half)
    return sorted(sorted(members(node)) for node in ends)


def median_welch_t(x: np.ndarray, members: list[int]) -> float:
    """Median over columns of Welch's t of the members' rows against all others; 0 where it is undefined."""
    inside = np.zeros(len(x), bool)
    inside[members] = True
    a, b = x[inside], x[~inside]
    if len(a) < 2 or len(b) < 2:
        return 0.0
    se = np.sqrt(a.var(axis=0, ddof=1) / len(a) + b.var(axis=0, ddof=1) / len(b))
    return float(np.median(np.where(se > 0, (a.mean(axis=0) - b.mean(axis=0)) / np.maximum(se, 1e-300), 0.0)))


def kmeans(x: np.ndarray, k: int, starts: int = 20, steps: int = 50) -> tuple[np.ndarray, float]:
    """Labels and cost of the best of several starts (distance-weighted seeds from fixed random numbers)."""
    best = (np.zeros(len(x), int), math.inf)
    for start in range(starts):
        rng = np.random.default_rng(start)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < min(k, len(x)):
            d = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            labels = d.argmin(axis=1)
            moved = np.stack([x[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(len(centres))])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = float(((x - centres[labels]) ** 2).sum())
        if cost < best[1] - 1e-12:
            best = (labels, cost)
    return best


def embedding_quality(x: np.ndarray, y: np.ndarray, k: int) -> dict[str, float]:
    """Trustworthiness, continuity, Spearman correlation of distances, and their score (0.4, 0.4, 0.2 of the correlation brought to 0..1)."""
    n = len(x)
    high, low = (np.sqrt(_squares(m)) for m in (x, y))

    def places(d: np.ndarray) -> np.ndarray:
        d = d.copy()
        np.fill_diagonal(d, -1)
        return d.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")

    rank = places(high), places(low)
    scale = 2 / (n * k * (2 * n - 3 * k - 1))
    kept = lambda near, far: 1 - scale * np.maximum(far - k, 0)[(near >= 1) & (near <= k)].sum()
    pairs = np.triu_indices(n, 1)
    ranks = [pd.Series(d[pairs]).rank().to_numpy() for d in (high, low)]
    rho = float(np.corrcoef(*ranks)[0, 1])
    trust, continuity = float(kept(rank[1], rank[0])), float(kept(rank[0], rank[1]))
    return {"trust": trust, "continuity": continuity, "rho": rho, "score": 0.4 * trust + 0.4 * continuity + 0.2 * (rho + 1) / 2}


def _squares(x: np.ndarray) -> np.ndarray:
    d = np.maximum((x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * x @ x.T, 0)
    np.fill_diagonal(d, 0)
    return d


def _principal(x: np.ndarray, k: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return u[:, :k] * s[:k]


def _descended(y: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """y after steps along the gradient(y, step), each coordinate scaled by its own running mean square."""
    mean, square = np.zeros_like(y), np.zeros_like(y)
    for t in range(1, steps + 1):
        g = gradient(y, t)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        y = y - rate * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return y


def tsne(x: np.ndarray, k: int, perplexity: float = 30.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """Coordinates whose Student-t neighbourhoods are nearest to the rows' Gaussian ones, and the divergence left."""
    d, n = _squares(x), len(x)
    target = math.log(min(perplexity, (n - 1) / 3))
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.full(n, 1 / max(d.mean(), 1e-12))
    away = np.where(np.eye(n, dtype=bool), np.inf, d - np.where(np.eye(n, dtype=bool), np.inf, d).min(axis=1, keepdims=True))
    for _ in range(60):
        p = np.exp(-np.where(np.isinf(away), np.inf, away * beta[:, None]))
        p /= p.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-15)

    def shares(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = 1 / (1 + _squares(y))
        np.fill_diagonal(t, 0)
        return t, np.maximum(t / t.sum(), 1e-15)

    def gradient(y: np.ndarray, step: int) -> np.ndarray:
        t, q = shares(y)
        w = ((4 if step <= steps // 4 else 1) * p - q) * t
        return 4 * (w.sum(axis=1)[:, None] * y - w @ y)

    start = _principal(x, k)
    y = _descended(start / max(start.std(), 1e-12) * 0.1, gradient, steps, 0.2)
    off = ~np.eye(n, dtype=bool)
    return y, float((p * np.log(p / shares(y)[1]))[off].sum())


def umap(x: np.ndarray, k: int, neighbours: int = 15, steps: int = 300) -> np.ndarray:
    """Coordinates that lower the cross entropy of fuzzy neighbour graphs, over all pairs rather than samples of them."""
    d, n = np.sqrt(_squares(x)), len(x)
    near = min(neighbours, n - 1)
    order = np.argsort(d + np.where(np.eye(n, dtype=bool), np.inf, 0), axis=1, kind="stable")[:, :near]
    away = np.take_along_axis(d, order, 1)
    away = np.maximum(away - away[:, :1], 0)
    low, high, width = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(60):
        wide = np.exp(-away / width[:, None]).sum(axis=1) > math.log2(near)
        high, low = np.where(wide, width, high), np.where(wide, low, width)
        width = np.where(np.isinf(high), width * 2, np.maximum((low + high) / 2, 1e-9))
    a = np.zeros((n, n))
    np.put_along_axis(a, order, np.exp(-away / width[:, None]), 1)
    w = a + a.T - a * a.T
    # The curve 1 / (1 + a d ** 2b) for a least distance of 0.1 and a spread of 1.
    ca, cb = 1.577, 0.895
    start = _principal(x, k)

    def gradient(y: np.ndarray, step: int) -> np.ndarray:
        s = _squares(y) + np.eye(n)
        power = ca * s**cb
        pull = w * 2 * cb * power / s / (1 + power)
        push = (1 - w) * 2 * cb / ((0.001 + s) * (1 + power))
        f = pull - push
        np.fill_diagonal(f, 0)
        return f.sum(axis=1)[:, None] * y - f @ y

    return _descended(start / max(np.abs(start).max(), 1e-12) * 10, gradient, steps, 0.2)


def reduced(x: np.ndarray, method: str, k: int) -> tuple[np.ndarray, float]:
    """Coordinates by pca, mds, isomap, fastica, tsne or umap, and the method's own criterion.

    pca: share of variance, and umap: quality score, to be large; mds: normalized stress, isomap: error of the centred
    geodesic Gram, fastica: reconstruction error over variance, tsne: divergence, to be small.
    """
    if method == "tsne":
        return tsne(x, k)
    if method == "umap":
        y = umap(x, k)
        return y, embedding_quality(x, y, 5)["score"]
    c = x - x.mean(axis=0)
    if method == "pca":
        y = _principal(x, k)
        return y, float((y**2).sum() / (c**2).sum())
    if method == "fastica":
        y = fast_ica(x, k)
        design = np.column_stack([y, np.ones(len(y))])
        return y, float(((x - design @ np.linalg.lstsq(design, x, rcond=None)[0]) ** 2).mean() / x.var())
    d = np.sqrt(_squares(c))
    if method == "mds":
        y = classical_mds(d, k)
        return y, float(np.sqrt(((d - np.sqrt(_squares(y))) ** 2).sum() / (d * d).sum()))
    g = geodesics(d, 6)
    y = classical_mds(g, k)
    centre = np.eye(len(x)) - 1 / len(x)
    return y, float(np.linalg.norm(centre @ (-0.5 * g * g) @ centre - y @ y.T) / len(x))


def hdbscan(x: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Labels (-1 noise) of the most stable clusters of the mutual-reachability hierarchy."""
    n = len(x)
    gap = np.empty_like(x)

    def away(v: int) -> np.ndarray:
        """Distances of a row to all; no more of them are held."""
        np.subtract(x, x[v], out=gap)
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    core = np.array([np.partition(away(v), min(samples, n - 1))[min(samples, n - 1)] for v in range(n)])
    seen, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    tree, v = [], 0
    for _ in range(n - 1):
        seen[v] = True
        reach = np.maximum(away(v), np.maximum(core, core[v]))
        closer = ~seen & (reach < best)
        best[closer], link[closer] = reach[closer], v
        v = int(np.argmin(np.where(seen, np.inf, best)))
        tree.append((best[v], link[v], v))
    tree.sort()
    top, node, members, kids, height = list(range(n)), list(range(n)), [1] * n, {}, {}

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for step, (w, a, b) in enumerate(tree):
        a, b = find(a), find(b)
        new = n + step
        kids[new], height[new] = (node[a], node[b]), w
        members.append(members[node[a]] + members[node[b]])
        top[b], node[a] = a, new
    stability, chosen = {}, {}

    def walk(root: int) -> None:
        stack = [(root, 0.0)]
        order = []
        while stack:
            cluster, birth = stack.pop()
            at, total, split = cluster, 0.0, None
            while at >= n:
                a, b = kids[at]
                lam = 1 / max(height[at], 1e-12)
                big = [c for c in (a, b) if members[c] >= least]
                total += (lam - birth) * (members[at] - (members[big[0]] if len(big) == 1 else 0))
                if len(big) == 1:
                    at = big[0]
                    continue
                split = (a, b, lam) if len(big) == 2 else None
                break
            stability[cluster] = total
            order.append((cluster, split))
            stack += [(c, split[2]) for c in split[:2]] if split else []
        for cluster, split in reversed(order):
            below = sum(stability[c] for c in split[:2]) if split else -1.0
            if split and (below > stability[cluster] or cluster == root):
                stability[cluster] = below
                chosen[cluster] = chosen[split[0]] + chosen[split[1]]
            else:
                chosen[cluster] = [cluster]

    labels = np.full(n, -1)
    if n > 1:
        walk(n + len(tree) - 1)
        for k, rows in enumerate(sorted((leaves(c, n, kids.get) for c in chosen[n + len(tree) - 1]), key=min)):
            if len(rows) >= least:
                labels[rows] = k
    return labels


def nmf(x: np.ndarray, k: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates from a fixed start."""
    n, d = x.shape
    w = 0.5 + (np.arange(n * k).reshape(n, k) * 7919 % 1009) / 1009
    h = 0.5 + (np.arange(k * d).reshape(k, d) * 104_729 % 1013) / 1013
    for _ in range(steps):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


class Hidden(NamedTuple):
    """A Gaussian hidden Markov model with diagonal variances."""

    first: np.ndarray
    move: np.ndarray
    means: np.ndarray
    var: np.ndarray

    def passed(self, x: np.ndarray, lengths: list[int]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood, state posteriors, expected moves and openings, runs apart, forwards and backwards."""
        k = len(self.first)
        logs = -0.5 * (((x[:, None] - self.means) ** 2 / self.var) + np.log(2 * np.pi * self.var)).sum(axis=2)
        top = logs.max(axis=1, keepdims=True)
        emit, gamma, xi, opening, total, at = np.exp(logs - top), np.zeros((len(x), k)), np.zeros((k, k)), np.zeros(k), float(top.sum()), 0
        for length in lengths:
            e = emit[at : at + length]
            alpha, scale = np.zeros((length, k)), np.zeros(length)
            for t in range(length):
                a = e[t] * (self.first if t == 0 else alpha[t - 1] @ self.move)
                scale[t] = max(a.sum(), 1e-300)
                alpha[t] = a / scale[t]
            beta = np.ones((length, k))
            for t in range(length - 2, -1, -1):
                ahead = e[t + 1] * beta[t + 1] / scale[t + 1]
                beta[t] = self.move @ ahead
                xi += self.move * np.outer(alpha[t], ahead)
            g = alpha * beta
            gamma[at : at + length] = g / g.sum(axis=1, keepdims=True)
            opening += gamma[at]
            total += float(np.log(scale).sum())
            at += length
        return total, gamma, xi, opening


def hmm_fit(x: np.ndarray, lengths: list[int], k: int, steps: int = 50, start: int = 0) -> Hidden:
    """By expectation maximization from k rows that the start picks."""
    order = np.argsort((np.arange(len(x)) * 7919 + start * 104_729) % 1_000_003)
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    model, total = Hidden(np.full(k, 1 / k), move, x[order[:k]].copy(), np.tile(x.var(axis=0) + 1e-3, (k, 1))), -np.inf
    for _ in range(steps):
        before, (total, gamma, xi, opening) = total, model.passed(x, lengths)
        weight = np.maximum(gamma.sum(axis=0), 1e-9)[:, None]
        means = gamma.T @ x / weight
        model = Hidden(opening / opening.sum(), (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True), means, np.maximum(gamma.T @ (x * x) / weight - means**2, 1e-3))
        if abs(total - before) < 1e-4 * abs(total):
            break
    return model


def hmm(x: np.ndarray, lengths: list[int], k: int, steps: int = 50, start: int = 0) -> tuple[float, np.ndarray]:
    """Log likelihood and state posteriors of the fitted model."""
    return hmm_fit(x, lengths, k, steps, start).passed(x, lengths)[:2]


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two labelings beyond chance: 1 if equal but for names, near 0 for unrelated ones."""
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    both, one, other, every = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), len(a) * (len(a) - 1) / 2
    chance = one * other / every
    most = (one + other) / 2
    return 1.0 if most == chance else (both - chance) / (most - chance)


def tfce(values: np.ndarray, near: list[list[int]], step: float = 0.1, e: float = 0.5, h: float = 2.0) -> np.ndarray:
    """Threshold-free cluster enhancement of positive and negative values on a graph, by descending union-find."""

    def one_side(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        for height in np.arange(step, v.max() + 1e-12, step):
            seen = np.zeros(len(v), bool)
            for start in np.flatnonzero(v >= height):
                if seen[start]:
                    continue
                stack, members = [int(start)], []
                seen[start] = True
                while stack:
                    u = stack.pop()
                    members.append(u)
                    for w in near[u]:
                        if not seen[w] and v[w] >= height:
                            seen[w] = True
                            stack.append(w)
                out[members] += len(members) ** e * height**h * step
        return out

    return one_side(values) - one_side(-values)


def classical_mds(d: np.ndarray, k: int) -> np.ndarray:
    """Coordinates from distances: eigenvectors of the double-centred squares, signs fixed by the largest entry."""
    c = -0.5 * d**2
    c = c - c.mean(axis=0) - c.mean(axis=1, keepdims=True) + c.mean()
    values, vectors = np.linalg.eigh(c)
    top = np.argsort(-values)[:k]
    x = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    return x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])


def geodesics(d: np.ndarray, k: int) -> np.ndarray:
    """Shortest paths along each row's k nearest (Isomap); unreachable pairs keep the straight distance."""
    n = len(d)
    g = np.full((n, n), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    g[np.arange(n)[:, None], order] = np.take_along_axis(d, order, 1)
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0)
    for m in range(n):
        np.minimum(g, g[:, m : m + 1] + g[m], out=g)
    return np.where(np.isfinite(g), g, d)


def fast_ica(x: np.ndarray, k: int, steps: int = 200) -> np.ndarray:
    """Independent components (tanh contrast, symmetric orthogonalization) from a fixed start."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    z = u[:, :k] * np.sqrt(len(x))
    w = np.linalg.qr(np.eye(k) + 0.1 * np.sin(np.arange(k * k)).reshape(k, k))[0]
    for _ in range(steps):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g * g).mean(axis=0)) @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return z @ w.T


def smooth_basis(near: list[list[int]], k: int) -> np.ndarray:
    """The k smoothest non-constant eigenvectors of a small graph's Laplacian."""
    n = len(near)
    laplacian = np.zeros((n, n))
    for i, others in enumerate(near):
        laplacian[i, i] = len(others)
        laplacian[i, others] = -1
    return np.linalg.eigh(laplacian)[1][:, 1 : k + 1]


def birch(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of sub-clusters by one pass of clustering features: a row joins the nearest whose radius stays small."""
    sums, centres, squares, sizes, labels = [], np.empty_like(x), [], [], np.zeros(len(x), int)
    for i, row in enumerate(x):
        m = len(sums)
        if m:
            gap = centres[:m] - row
            j = int(np.einsum("ij,ij->i", gap, gap).argmin())
            n, s, q = sizes[j] + 1, sums[j] + row, squares[j] + row @ row
            if math.sqrt(max(q / n - (s / n) @ (s / n), 0)) <= threshold:
                sums[j], squares[j], sizes[j], labels[i], centres[j] = s, q, n, j, s / n
                continue
        labels[i], centres[m] = m, row
        sums.append(row.copy())
        squares.append(float(row @ row))
        sizes.append(1)
    return labels
