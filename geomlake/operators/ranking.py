"""Ranks of a label's pairs without a table of pairs.

Distances of pairs are cheap and pairs are many, so no pair is stored or dealt out. A label's rows
lie in the shared folder, in the order of vec_id; pairs i > j in the order of (i, j) are numbered
from 0, and a task owns OWN of them in a row. It goes over all pairs of the label, CHUNK at a time,
and counts how many are below each of its own: so its ranks are exact and its memory has a bound,
whatever the label's size or its ties. What leaves a task are sums, or its own pairs.

Rows are linear in a label and pairs are not: the passes take pairs times tasks of a label, so time
grows with the square of a label's pairs over OWN where a table of pairs would grow in disk. Searchlights
rank many times, so their tasks own more (LIGHT) and carry the seed's ranks along while they sort.
Distances are computed by bands of rows, always the same ones, so that a value equals itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomlake.functions import special
from geomlake.operators import blocked
from geomlake.sources import store

#: Pairs that a task owns, that it sorts at a time; rows of a band at most.
OWN, CHUNK, BAND = 6_000_000, 12_000_000, 256
#: Of searchlights: pairs that a task owns, that it sorts at a time, and of a band.
LIGHT, STRETCH, CELLS = 72_000_000, 2**24, 2**17
Measures = dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]


class Pairs:
    """The pairs of one label's rows, numbered in the order of (i, j); a task owns those from first to last."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, part: int, parts: int, cells: int | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.n, self.part, self.parts = len(ids) * (len(ids) - 1) // 2, part, parts
        step = max(1, min(BAND, (cells or CHUNK // 6) // max(1, len(ids))))
        self.bands = [(s, min(s + step, len(ids))) for s in range(0, len(ids), step)]
        owner = [s * (s - 1) // 2 * parts // max(1, self.n) for s, _ in self.bands]
        self.own = [b for b, at in zip(self.bands, owner, strict=True) if at == part]
        self.first, self.last = (self.start(self.own[0][0]), self.start(self.own[-1][1])) if self.own else (0, 0)

    @staticmethod
    def start(row: int) -> int:
        """The number of the first pair whose i is the row."""
        return row * (row - 1) // 2

    #: Which of several jobs on the same pairs.
    job = 0

    def of(self, measure: Callable, band: tuple[int, int]) -> np.ndarray:
        s, e = band
        return measure(self.x[s:e], self.x[:e])[np.arange(e) < np.arange(s, e)[:, None]]

    def values(self, measure: Callable, more: np.ndarray | None = None) -> np.ndarray:
        """The own pairs' values, and those of more pairs by number."""
        parts = [self.of(measure, b) for b in self.own] or [np.zeros(0)]
        if more is not None and len(more):
            held, ends = np.zeros(len(more)), np.array([self.start(e) for _, e in self.bands])
            band = np.searchsorted(ends, more, side="right")
            for b in np.unique(band).tolist():
                here = band == b
                held[here] = self.of(measure, self.bands[b])[more[here] - self.start(self.bands[b][0])]
            parts.append(held)
        return np.concatenate(parts)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """i and j of the own pairs."""
        rows = np.concatenate([np.arange(s, e) for s, e in self.own]) if self.own else np.zeros(0, int)
        i = np.repeat(rows, rows)
        return self.ids[i], self.ids[np.arange(self.first, self.last) - i * (i - 1) // 2]

    def chunks(self, measure: Callable) -> Iterator[tuple[int, np.ndarray]]:
        """All values of the label, sorted inside chunks of whole bands, with the number of a chunk's first pair. Own and other bands do not mix."""
        held = np.empty(min(self.n, max(CHUNK, max((self.start(e) - self.start(b) for b, e in self.bands), default=0))))
        size, at, was = 0, 0, None
        for band in self.bands:
            mine = self.first <= self.start(band[0]) < self.last
            more = self.start(band[1]) - self.start(band[0])
            if size and (size + more > len(held) or mine != was):
                held[:size].sort()
                yield at, held[:size]
                at, size = at + size, 0
            held[size : size + more] = self.of(measure, band)
            size, was = size + more, mine
        if size:
            held[:size].sort()
            yield at, held[:size]

    def ranks(self, measure: Callable, method: str = "average", more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ranks from 1 and values of the own pairs and of more: equal values share their mean or their least rank, or go by number."""
        own = self.values(measure, more)
        order = np.argsort(own, kind="stable" if method == "ordinal" else None)
        held = own[order]
        below, upto = np.zeros(len(own), np.int64), np.zeros(len(own) if method == "average" else 0, np.int64)
        for at, chunk in self.chunks(measure):
            if method == "ordinal":
                # Of equal values those with a smaller number come first; the own ones are in that order already.
                mine = self.first <= at < self.last
                if not mine:
                    below += np.searchsorted(chunk, held, side="right" if at < self.first else "left")
                continue
            left = np.searchsorted(chunk, held)
            below += left
            if method == "average":
                upto += left
                tied = np.flatnonzero(chunk[np.minimum(left, len(chunk) - 1)] == held)
                upto[tied] += np.searchsorted(chunk, held[tied], side="right") - left[tied]
        out = np.empty(len(own))
        out[order] = {"average": lambda: (below + upto + 1) / 2, "min": lambda: below + 1, "ordinal": lambda: below + np.arange(1, len(own) + 1)}[method]()
        return out, own


def over_pairs(rows: DataFrame, kernel: Callable[[Pairs], Iterator[dict]], schema: str, jobs: int = 1, own: int | None = None, cells: int | None = None) -> DataFrame:
    """label and what kernel(pairs) yields (columns of arrays), for each task of each label of rows (vec_id, label, x).

    With several jobs a task has one of them, pairs.job. Rows without a label have no pairs. own, cells: pairs
    of a task, if not OWN, and of a band.
    """
    spark = rows.sparkSession
    held = rows.where("label IS NOT NULL").select("vec_id", F.col("label").cast("int").alias("label"), "x")
    folder = store.shared_folder(spark, "labels")
    held.repartition("label").write.partitionBy("label").parquet(folder)
    sizes = [(r["label"], r["count"]) for r in held.groupBy("label").count().collect()]  # a row for each label
    tiles = [(label, k, parts, job) for label, n in sizes for parts in [max(1, -(-(n * (n - 1) // 2) // (own or OWN)))] for k in range(parts) for job in range(jobs)]
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    types = pa.schema([("label", pa.int32()), *[(name, kind) for name, kind in zip(fields, _kinds(schema), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                table = store.read_folder(f"{folder}/label={tile['label']}", ["vec_id", "x"])
                pairs = Pairs(table["vec_id"].to_numpy(), np.array(table["x"].to_pylist(), float), tile["part"], tile["parts"], cells)
                pairs.job = tile["job"]
                if not pairs.n:
                    continue
                for out in kernel(pairs):
                    n = len(out[fields[0]])
                    for at in range(0, n, 500_000):
                        cut = {k: v[at : at + 500_000] for k, v in out.items()}
                        label = pa.array(np.full(len(cut[fields[0]]), tile["label"], np.int32))
                        yield pa.RecordBatch.from_arrays([label, *(pa.array(cut[f], types.field(f).type) for f in fields)], schema=types)

    dealt = spark.createDataFrame(tiles, "label int, part int, parts int, job int")
    # Ranges of so few rows are exact: a task for each tile.
    return dealt.repartitionByRange(max(1, min(len(tiles), 10_000)), "label", "part", "job").mapInArrow(run, f"label int, {schema}")


def _kinds(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return [kinds[c.split(" ")[-1]] for c in schema.split(", ")]


def correlations(rows: DataFrame, measures: Measures, wanted: list[tuple[str, str]], method: str = "average") -> DataFrame:
    """label, n (pairs), <u>_<v> (correlation of ranks) of each wanted two measures, and mean_<u> of each measure's values."""
    names = list(measures)
    columns = [f"m_{u}" for u in names] + [f"s_{u}" for u in names] + [f"q_{u}" for u in names] + [f"p_{u}_{v}" for u, v in wanted]

    def sums(pairs: Pairs) -> Iterator[dict]:
        middle, ranks, out = (pairs.n + 1) / 2, {}, {"n": [pairs.last - pairs.first]}
        for u, measure in measures.items():
            ranks[u], values = pairs.ranks(measure, method)
            ranks[u] -= middle
            out |= {f"m_{u}": [values.sum()], f"s_{u}": [ranks[u].sum()], f"q_{u}": [ranks[u] @ ranks[u]]}
        yield out | {f"p_{u}_{v}": [ranks[u] @ ranks[v]] for u, v in wanted}

    found = over_pairs(rows, sums, "n long, " + ", ".join(f"{c} double" for c in columns))
    held = found.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n", *columns)])
    return held.select("label", "n", *[(F.col(f"m_{u}") / F.col("n")).alias(f"mean_{u}") for u in names], *[_corr(u, v).alias(f"{u}_{v}") for u, v in wanted])


def _corr(u: str, v: str) -> Column:
    """The correlation from sums, null without variation."""
    c, n = F.col, F.col("n")
    norm = F.sqrt((c(f"q_{u}") - c(f"s_{u}") * c(f"s_{u}") / n) * (c(f"q_{v}") - c(f"s_{v}") * c(f"s_{v}") / n))
    return F.when(norm > 0, (c(f"p_{u}_{v}") - c(f"s_{u}") * c(f"s_{v}") / n) / norm)


def shifted(rows: DataFrame, base: Callable, others: Measures, offsets: list[int]) -> DataFrame:
    """label, off, and r_<other>: correlation of the base's ranks with those of the other measure `off` pairs on, in a circle."""

    def sums(pairs: Pairs) -> Iterator[dict]:
        middle, reach = (pairs.n + 1) / 2, max(offsets)
        x = pairs.ranks(base)[0] - middle
        out = {"off": offsets, "qx": [x @ x, *[0.0] * (len(offsets) - 1)]}
        more = (pairs.last + np.arange(reach)) % pairs.n
        for name, measure in others.items():
            y = pairs.ranks(measure, more=more)[0] - middle
            out |= {f"q_{name}": [y[: len(x)] @ y[: len(x)], *[0.0] * (len(offsets) - 1)], f"p_{name}": [x @ y[off : off + len(x)] for off in offsets]}
        yield out

    columns = ["qx", *[f"{k}_{name}" for name in others for k in "qp"]]
    found = over_pairs(rows, sums, "off int, " + ", ".join(f"{c} double" for c in columns))
    held = found.groupBy("label", "off").agg(*[F.sum(c).alias(c) for c in columns])
    # Over a label's few offsets, so that the passes are made once.
    whole = Window.partitionBy("label")
    held = held.withColumns({f"_{c}": F.sum(c).over(whole) for c in columns if c.startswith("q")})
    r = lambda name: F.when(F.col("_qx") * F.col(f"_q_{name}") > 0, F.col(f"p_{name}") / F.sqrt(F.col("_qx") * F.col(f"_q_{name}")))
    return held.select("label", "off", *[r(name).alias(f"r_{name}") for name in others])


def numbered(rows: DataFrame, measure: Callable, prepared: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """label, i, j, rk: each pair's number from 0 in its label's order of (measure of prepared rows, i, j)."""

    def places(pairs: Pairs) -> Iterator[dict]:
        pairs.x = prepared(pairs.x)
        rank = pairs.ranks(measure, "ordinal")[0]
        i, j = pairs.names()
        yield {"i": i, "j": j, "rk": rank.astype(np.int64) - 1}

    return over_pairs(rows, places, "i long, j long, rk long")


class Lights:
    """Ranks of all of a label's pairs by one measure after another, by sorting them a stretch of values at a time.

    A measure is correlation distances of some features, counted in units of 1e-12. What a pair carries
    along, an integer, lies in the lower bits of its key, so that sorting keys is all there is to do. A stretch holds
    STRETCH pairs at most and is sorted in pieces narrow enough for the key's upper bits; each stretch
    computes all distances anew. Of a task's own pairs their rank by the seed is carried, of others none.
    """

    def __init__(self, pairs: Pairs):
        self.pairs, self.n = pairs, pairs.n
        self.band = np.empty(max(((e - s) * e for s, e in pairs.bands), default=0))
        rows = max((e - s for s, e in pairs.bands), default=0)
        self.beyond = np.triu(np.ones((rows, rows), bool))
        self.at, size = {}, 0
        for s, e in pairs.own:
            self.at[s] = size
            size += (e - s) * e
        #: Of the own bands, whole rectangles of (i, j): twice the centred rank by the seed, plus n.
        self.model = np.full(size, self.n, np.int32 if self.n < 2**30 else np.int64)

    def keys(self, z: np.ndarray, band: tuple[int, int]) -> np.ndarray:
        """A band's distances in units of 1e-12, infinite where j is not below i."""
        s, e = band
        d = self.band[: (e - s) * e].reshape(e - s, e)
        np.matmul(z[s:e], z[:e].T, out=d)
        np.subtract(1, d, out=d)
        np.multiply(d, 1e12, out=d)
        np.rint(d, out=d)
        np.copyto(d[:, s:e], np.inf, where=self.beyond[: e - s, : e - s])
        return d.ravel()

    def stretches(self, z: np.ndarray) -> list[tuple[int, int]]:
        """Bounds of values with as many pairs each, more or less, by quantiles of a few rows."""
        few = z[:: -(-len(z) // 1000)]
        d = np.rint((1 - few @ few.T)[np.tri(len(few), k=-1, dtype=bool)] * 1e12)
        parts = max(1, -(-self.n // max(1, STRETCH * 7 // 8)))
        inner = np.unique(np.quantile(d, np.arange(1, parts) / parts).astype(np.int64)).tolist() if len(d) else []
        ends = [-(2**20), *[v for v in inner if 0 < v < 2 * 10**12], 2 * 10**12 + 2**20]  # 0 to 2 but for rounding
        return [*zip(ends, ends[1:], strict=False)]

    def chosen(self, z: np.ndarray, low: int, high: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        """Bands, the places in their rectangles and the keys of pairs from low to below high."""
        for band in self.pairs.bands:
            key = self.keys(z, band)
            here = np.flatnonzero((key >= low) & (key < high))
            if len(here):
                yield band, here, key.take(here)

    def ranks(self, features: list[int], carried: Callable, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What carried(band, places) gives for all pairs, 0 to most, and twice their centred ranks; equal distances share a rank."""
        x = self.pairs.x[:, features]
        c = x - x.mean(axis=1, keepdims=True)
        z = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        bits, below, waiting = most.bit_length(), 0, self.stretches(z)
        while waiting:
            low, high = waiting.pop(0)
            if high - low == 1:  # one value
                count = sum(len(here) for _, here, _ in self.chosen(z, low, high))
                for band, here, _ in self.chosen(z, low, high):
                    yield carried(band, here), np.full(len(here), 2.0 * below + count - self.n)
                below += count
                continue
            pieces: list[list[np.ndarray]] = [[] for _ in range((high - low >> 64 - bits) + 1)]
            count = 0
            for band, here, key in self.chosen(z, low, high):
                count += len(here)
                if count > STRETCH:
                    waiting[:0] = [(low, (low + high) // 2), ((low + high) // 2, high)]
                    break
                key -= low
                value = key.astype(np.int64)
                of = value >> 64 - bits
                value <<= bits
                value |= carried(band, here)
                for k, piece in enumerate(pieces):
                    piece.append(value.take(np.flatnonzero(of == k)) if len(pieces) > 1 else value)
            else:
                for piece in pieces:
                    held = np.concatenate(piece or [np.zeros(0, np.int64)]).view(np.uint64)
                    piece.clear()
                    held.sort()
                    yield from self._ranked(held, bits, below)
                    below += len(held)
            del pieces

    def _ranked(self, held: np.ndarray, bits: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of whole groups of equal values."""
        start, lower = 0, np.uint64(2**bits - 1)
        while start < len(held):
            stop = min(start + 2**15, len(held))
            stop = int(np.searchsorted(held, held[stop - 1] | lower, side="right"))
            part = held[start:stop]
            rank = np.arange(2 * (below + start) + 1 - self.n, 2 * (below + stop) + 1 - self.n, 2, dtype=float)
            again = np.flatnonzero((part[1:] ^ part[:-1]) <= lower)
            if len(again):
                new = np.flatnonzero(np.diff(again, prepend=-2) > 1)
                first, last = again[new], again[np.append(new[1:], len(again)) - 1] + 1
                size = last - first + 1
                among = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rank[np.repeat(first, size) + among] = np.repeat((rank[first] + rank[last]) / 2, size)
            yield (part & lower).view(np.int64), rank
            start = stop

    def rank_model(self, features: list[int]) -> float:
        """Sets the own pairs' ranks by the seed features; the sum of squares of all."""
        total = 0.0
        at = lambda band, here: here + (self.at[band[0]] + 1) if band[0] in self.at else 0
        for where, rank in self.ranks(features, lambda band, here: np.broadcast_to(at(band, here), len(here)), len(self.model)):
            own = where > 0
            self.model[where[own] - 1] = rank[own] + self.n
            total += rank @ rank
        return total

    def against_model(self, features: list[int]) -> tuple[float, float]:
        """Sums of the products of ranks with the seed's, of own pairs, and of squares of all."""
        p = q = 0.0
        seed = lambda band, here: self.model[self.at[band[0]] :].take(here) if band[0] in self.at else np.broadcast_to(self.n, len(here))
        for model, rank in self.ranks(features, seed, 2 * self.n):
            p, q = p + rank @ (model - float(self.n)), q + rank @ rank
        return float(p), float(q)


def searchlights(rows: DataFrame, neighbours: dict[int, list[int]], seed: list[int], block: int = 16) -> DataFrame:
    """label, centre, value: Spearman correlation over a label's pairs of each neighbourhood's correlation distances with the seed features'.

    Distances count to 12 decimals. Under 2 features, or without variation: 0. A task has a block of a label's
    centres, for LIGHT of its pairs, and sorts all pairs once for each centre.
    """
    centres = sorted(neighbours)
    blocks = [centres[at : at + block] for at in range(0, len(centres), block)]

    def sums(pairs: Pairs) -> Iterator[dict]:
        lights, once = Lights(pairs), pairs.part == 0  # sums over all pairs count once
        m = lights.rank_model(seed)
        for centre in blocks[pairs.job]:
            p, q = lights.against_model(neighbours[centre]) if len(neighbours[centre]) > 1 else (0.0, 0.0)
            yield {"centre": [centre], "p": [p], "q": [q * once], "m": [m * once]}

    found = over_pairs(rows, sums, "centre int, p double, q double, m double", len(blocks), LIGHT, CELLS).groupBy("label", "centre").agg(*[F.sum(c).alias(c) for c in "pqm"])
    return found.select("label", "centre", F.when(F.col("q") * F.col("m") > 0, F.col("p") / F.sqrt(F.col("q") * F.col("m"))).otherwise(0.0).alias("value"))


def kept_neighbours(rows: DataFrame, high: Callable, low: Callable, k: int) -> DataFrame:
    """label, n (rows), trust, continuity: sums over rows of how far beyond k the ranks by high of the k nearest by low lie, and the other way round.

    Ranks are among the label's other rows, ties by vec_id. A task has the rows of its bands against all of the label.
    """

    def beyond(near: np.ndarray, far: np.ndarray, most: int) -> int:
        kth = np.partition(near, most - 1, axis=1)[:, most - 1 : most]
        chosen = near <= kth
        for row in np.flatnonzero(chosen.sum(axis=1) != most).tolist():
            chosen[row] = False
            chosen[row, np.argsort(near[row], kind="stable")[:most]] = True
        at, total, places = np.nonzero(chosen)[1].reshape(-1, most), 0, np.arange(near.shape[1])
        for column in at.T:
            d = np.take_along_axis(far, column[:, None], 1)
            rank = 1 + (far < d).sum(axis=1) + ((far == d) & (places < column[:, None])).sum(axis=1)
            total += int(np.maximum(rank - k, 0).sum())
        return total

    def sums(pairs: Pairs) -> Iterator[dict]:
        n, trust, continuity = len(pairs.ids), 0, 0
        for s, e in pairs.own:
            h, l = (m(pairs.x[s:e], pairs.x) for m in (high, low))  # noqa: E741
            for d in (h, l):
                d[np.arange(e - s), np.arange(s, e)] = np.inf
            trust, continuity = trust + beyond(l, h, min(k, n - 1)), continuity + beyond(h, l, min(k, n - 1))
        yield {"n": [n], "trust": [trust], "continuity": [continuity]}

    found = over_pairs(rows, sums, "n long, trust long, continuity long")
    return found.groupBy("label").agg(F.max("n").alias("n"), F.sum("trust").alias("trust"), F.sum("continuity").alias("continuity"))


def kendall(rows: DataFrame, a: Callable, b: Callable) -> DataFrame:
    """label, tau: Kendall's tau-b of two measures over a label's pairs.

    A task has a stretch of a's values, by quantiles of a few rows: its pairs are met with one another by
    their places, and with the pairs of smaller a by sorting those by b. Equal values stay in one task.
    """
    tied = lambda v: int((c * (c - 1) // 2).sum()) if len(v) and len(c := np.diff(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])))) else 0

    def sums(pairs: Pairs) -> Iterator[dict]:
        x = pairs.x[:: -(-len(pairs.x) // 1000)] if len(pairs.x) > 1000 else pairs.x
        lower = np.tri(len(x), k=-1, dtype=bool)

        def stretch(measure: Callable) -> tuple[float, float]:
            splits = np.quantile(measure(x, x)[lower], np.arange(1, pairs.parts) / pairs.parts)
            ends = [-np.inf, *splits.tolist(), np.inf]
            return ends[pairs.part], ends[pairs.part + 1]

        low, high = stretch(a)
        parts = []
        for band in pairs.bands:
            v = pairs.of(a, band)
            here = (v >= low) & (v < high)
            parts.append((v[here], pairs.of(b, band)[here]))
        u, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        places = np.unique(w, return_inverse=True)
        discordant, tied_a = special.inversions(places[1]), tied(u)
        same = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]), [True]]))
        tied_both = int((np.diff(same) * (np.diff(same) - 1) // 2).sum()) if len(u) else 0
        count, held = len(u), np.sort(w)
        del u, w, order, places, same
        waiting, size = [], 0
        for k, band in enumerate(pairs.bands):
            waiting.append(pairs.of(b, band)[pairs.of(a, band) < low] if low > -np.inf else np.zeros(0))
            size += len(waiting[-1])
            if size and (size >= CHUNK // 2 or k == len(pairs.bands) - 1):
                chunk, waiting, size = np.sort(np.concatenate(waiting)), [], 0
                discordant += len(chunk) * count - int(np.searchsorted(chunk, held, side="right").sum())
        low, high = stretch(b)
        mine = np.sort(np.concatenate([v[(v >= low) & (v < high)] for band in pairs.bands for v in [pairs.of(b, band)]]))
        yield {"n": [pairs.n], "own_a": [count], "own_b": [len(mine)], "discordant": [discordant], "tied_a": [tied_a], "tied_b": [tied(mine)], "tied_both": [tied_both]}

    names = ["own_a", "own_b", "discordant", "tied_a", "tied_b", "tied_both"]
    found = over_pairs(rows, sums, "n long, " + ", ".join(f"{c} long" for c in names))
    c, n = F.col, F.col("n")
    held = found.groupBy("label").agg(F.max("n").alias("n"), *[F.sum(name).alias(name) for name in names])
    # Tasks compute the splits themselves: had machines differed in a last bit, a pair might be missing.
    held = held.withColumn("n", F.when((c("own_a") == n) & (c("own_b") == n), n).otherwise(F.raise_error(F.lit("tasks disagree on the stretches of values"))))
    total = F.shiftright(n * (n - 1), 1)
    base = F.sqrt((total - c("tied_a")).cast("double") * (total - c("tied_b")).cast("double"))
    return held.select("label", F.when(base > 0, (total - c("tied_a") - c("tied_b") + c("tied_both") - 2 * c("discordant")) / base).alias("tau"))
