"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees what is written: the profile of its byte pairs, how its words repeat, its lines and
marks. The metadata view sees the record alone: language, source and recorded size. Both are logistic
regressions, first fitted on the labelled sample. Then, in ROUNDS passes over all other rows, each view
hands the rows that it is sure of to the other as labels, and both take a step of Newton's kind, on a
parabola above the loss, on the sample's and all these rows. A view's log-odds are calibrated on labelled rows kept out of the fitting, in each
round anew, and sure is a calibrated probability of SURE: a view that tells nothing hands over nothing.
Of each class the handed rows weigh together as much as the labelled ones (or one each, if that is
less), however many there are. At the end a regression on further labelled rows combines both
calibrated views. The combination scores every row's whole text.

What is bounded is the labelled sample, the LABELLED rows, of those with a label, with the smallest
hashes of their doc_id: half of them fit, a quarter calibrate, a quarter combine. Pseudo-labels come from all
rows outside the sample: their features are a stored table, and a pass adds up gradients and second
derivatives on the executors, of which a few ten thousand numbers reach the driver.

A row is kept unless its score is below a cut that 99.8 % of the good rows kept out of the fitting
pass, and below one half.

Cases: a null text counts as empty; null metadata is a value of its own, a null or negative size too;
labels that are null are unlabelled, and contradicting labels of a doc_id count by their mean, rounded
up; where a class has fewer than 16 labelled rows, all rows get score 1 and are kept; of rows that share
a labelled doc_id, the one with the smallest hash of its text and metadata is the sample's; equal scores
are alike kept or not; repeated rows are scored each; a null doc_id is kept, and never labelled; an empty
table gives no row; extra columns are ignored by scored() and handed on by accepted().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomlake.llm import common

LABELLED, ROUNDS, SURE = 12_000, 4, 0.97
PAIRS, LANGS, SOURCES, SIZES, PASS = 256, 32, 64, 24, 0.998
#: Numbers of the text view; blocks that the sums of a pass are added up in.
TEXT, BLOCKS = PAIRS + 10, 16
_FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_view(text: str) -> np.ndarray:
    """Roots of the shares of hashed byte pairs, word statistics, lines and kinds of characters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    low = raw.astype(np.uint32) + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint32)
    pairs = ((low[:-1] * 257 + low[1:]) * np.uint32(2654435761)) >> np.uint32(24) if len(low) > 1 else np.zeros(0, np.uint32)
    profile = np.sqrt(np.bincount(pairs, minlength=PAIRS) / max(1, len(pairs)))
    words = text.split()
    n, distinct = len(words), len(set(words))
    follow = sum(map(str.__eq__, words, words[1:])) if distinct < 0.8 * n else 0
    size, lines = max(1, len(raw)), text.count("\n") + 1
    kind = np.bincount(_KIND[raw], minlength=4) / size
    said = [distinct / max(1, n), np.log1p(n), min(len(text) / max(1, n), 40) / 10, follow / max(1, n), np.log1p(distinct) / np.log1p(n) if n else 1.0]
    return np.concatenate([profile, said, [np.log1p(lines), np.log1p(size / lines) / 5], kind[1:] * 10])


#: Byte kinds: 0 letters and the rest, 1 digits, 2 sentence marks, 3 other ASCII symbols.
_KIND = np.array([1 if 48 <= b <= 57 else 2 if chr(b) in ".,;:!?'\"-()" else 3 if 32 < b < 127 and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def metadata_codes(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """Hashed language and source (0: null), and the whole part of the size's logarithm to base 2 (0: none)."""
    size = 0 if n_chars is None or n_chars < 0 else min(SIZES - 1, int(n_chars + 1).bit_length())
    return 0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANGS - 1), 0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1), size


def metadata_view(codes: np.ndarray) -> np.ndarray:
    """One column for each value of each code."""
    out = np.zeros((len(codes), LANGS + SOURCES + SIZES))
    for k, start in enumerate((0, LANGS, LANGS + SOURCES)):
        out[np.arange(len(codes)), start + codes[:, k]] = 1
    return out


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The text view, in half precision, and the metadata codes of a batch with _FIELDS in front."""
    text, *record = (batch.column(k).to_pylist() for k in range(1, 5))
    codes = np.array([metadata_codes(*m) for m in zip(*record, strict=True)], np.uint8).reshape(-1, 3)
    return np.array([text_view(t or "") for t in text], np.float16).reshape(-1, TEXT), codes


class Regression(NamedTuple):
    """Logistic regression on standardized columns; the last weight is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.columns(x) @ self.weights, -30, 30)

    def slopes(self, x: np.ndarray, y: np.ndarray, above: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the rows' loss by the weights.

        With `above`, the second ones of the parabola that touches the loss here and lies above it
        elsewhere, so that a step never overshoots, whatever rows have come.
        """
        z, odds = self.columns(x), self.odds(x)
        p, size = 1 / (1 + np.exp(-odds)), np.maximum(np.abs(odds), 1e-6)
        curve = np.tanh(size / 2) / (2 * size) if above else np.maximum(p * (1 - p), 1e-6)
        return z.T @ (p - y), (z * curve[:, None]).T @ z

    def stepped(self, first: np.ndarray, second: np.ndarray, ridge: float = 1.0) -> Regression:
        """After a Newton step with a ridge penalty."""
        penalty = np.full(len(self.weights), ridge)
        penalty[-1] = 1e-6
        return self._replace(weights=self.weights - np.clip(np.linalg.solve(second + np.diag(penalty), first + penalty * self.weights), -4, 4))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Regression:
    """By Newton's method with a ridge penalty."""
    x = np.asarray(x, float)
    out = Regression(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(x.shape[1] + 1))
    for _ in range(steps):
        before, out = out, out.stepped(*out.slopes(x, y), ridge)
        if np.abs(out.weights - before.weights).max() < 1e-6:
            break
    return out


class Model(NamedTuple):
    """Both views with their calibrations, their combination and the cut."""

    views: tuple[Regression, Regression]
    calibrations: tuple[Regression, Regression]
    both: Regression
    cut: float

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined probability, and each view's calibrated one."""
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, metadata), strict=True)]
        return tuple(1 / (1 + np.exp(-o)) for o in (self.both.odds(np.stack(odds, axis=1)), *odds))


#: For each view, then each class that the other view is sure of: how many rows, and their derivatives.
Sums = list[list[tuple[float, np.ndarray, np.ndarray]]]


#: Both views, then their calibrations.
Views = tuple[tuple[Regression, Regression], tuple[Regression, Regression]]


def handed(now: Views, xs: tuple[np.ndarray, np.ndarray]) -> Sums:
    """What rows without labels teach each view, by the other's sure labels."""
    views, limit = now[0], np.log(SURE / (1 - SURE))
    odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(*now, xs, strict=True)]
    out = []
    for me, other in ((0, 1), (1, 0)):
        given = [odds[other] <= -limit, odds[other] >= limit]
        out.append([(float(sure.sum()), *views[me].slopes(xs[me][sure], np.full(sure.sum(), float(label)), above=True)) for label, sure in enumerate(given)])
    return out


def co_trained(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, key: np.ndarray, pool: Callable[[Views], Sums], rounds: int = ROUNDS) -> Model | None:
    """Fits on labelled rows, dealt to fitting, calibration and combination by key, and on what the pool hands over."""
    part = key % 4
    shares = (part >= 2, part == 0, part == 1)
    if min(np.sum(s & (y == c)) for s in shares for c in (0, 1)) < 2 or min(np.sum(y == c) for c in (0, 1)) < 16:
        return None
    fit, calibrate, combine = shares
    xs = (np.asarray(text, float), np.asarray(metadata, float))
    views = tuple(fitted(x[fit], y[fit]) for x in xs)
    calibrated = lambda: tuple(fitted(v.odds(x[calibrate])[:, None], y[calibrate]) for v, x in zip(views, xs, strict=True))
    for _ in range(rounds):
        stepped = []
        for view, x, classes in zip(views, xs, pool((views, calibrated())), strict=True):
            first, second = view.slopes(x[fit], y[fit], above=True)
            for c, (n, g, h) in enumerate(classes):
                weight = min(1.0, np.sum(y[fit] == c) / max(n, 1.0))
                first, second = first + weight * g, second + weight * h
            stepped.append(view.stepped(first, second))
        views = tuple(stepped)
    calibrations = calibrated()
    stacked = np.stack([c.odds(v.odds(x[combine])[:, None]) for v, c, x in zip(views, calibrations, xs, strict=True)], axis=1)
    model = Model(views, calibrations, fitted(stacked, y[combine]), 0.5)
    good = ~fit & (y == 1)
    return model._replace(cut=float(min(0.5, np.quantile(model.scores(xs[0][good], xs[1][good])[0], 1 - PASS))))


def packed(sums: Sums) -> np.ndarray:
    """All numbers of the sums, of symmetric matrices the upper half."""
    return np.concatenate([np.concatenate([[n], g, h[np.triu_indices(len(g))]]) for view in sums for n, g, h in view])


def unpacked(flat: np.ndarray, widths: tuple[int, int]) -> Sums:
    out, at = [], 0
    for width in widths:
        out.append([])
        for _ in range(2):
            half, upper = width * (width + 1) // 2, np.triu_indices(width)
            h = np.zeros((width, width))
            h[upper] = flat[at + 1 + width : at + 1 + width + half]
            out[-1].append((flat[at], flat[at + 1 : at + 1 + width], h + np.triu(h, 1).T))
            at += 1 + width + half
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of text and metadata), x (text view), codes (metadata) of every row; stored."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = [pa.array([r.tobytes() for r in part], pa.binary()) for part in features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), *rows], ["doc_id", "mark", "x", "codes"])

    mark = F.xxhash64("text", "lang", "source", "n_chars").alias("mark")
    return common.saved(_fields(docs).select(*_FIELDS, mark).mapInArrow(extract, "doc_id long, mark long, x binary, codes binary"), "quality-features")


def views_of(x: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both views of measured rows."""
    text = np.frombuffer(b"".join(x.to_pylist()), np.float16).reshape(-1, TEXT).astype(float)
    return text, metadata_view(np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, 3))


def taught(rows: DataFrame, sampled: np.ndarray, now: Views) -> Sums:
    """handed() over all measured rows but those of the sample's doc_ids."""
    shared = rows.sparkSession.sparkContext.broadcast((now, np.sort(sampled)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sampled = shared.value
        total = None
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            out = batch.filter(pa.array(~np.isin(ids, sampled) | batch.column(0).is_null().to_numpy(zero_copy_only=False)))
            for start in range(0, out.num_rows, 4096):
                part = out.slice(start, 4096)
                flat = packed(handed(now, views_of(part.column(1), part.column(2))))
                total = flat if total is None else total + flat
        if total is not None:
            parts = np.array_split(total, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array(np.full(BLOCKS, TaskContext.get().partitionId())), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "task", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[block] = held.get(block, 0.0) + np.frombuffer(sums)
        for block, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])

    schema = "block long, task long, sums binary"
    parts = rows.select("doc_id", "x", "codes").mapInArrow(add, schema).repartition(BLOCKS, "block").sortWithinPartitions("block", "task")
    found = parts.mapInArrow(merge, "block long, sums binary").toArrow().sort_by("block")
    shared.unpersist()
    widths = tuple(len(v.weights) for v in now[0])
    return unpacked(np.frombuffer(b"".join(found["sums"].to_pylist())) if found.num_rows else np.zeros(sum(2 * (1 + w + w * (w + 1) // 2) for w in widths)), widths)


def learned(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The model from the bounded labelled sample and all other rows."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = ids.join(known, "doc_id").select("doc_id", "y", F.xxhash64("doc_id").alias("key")).orderBy("key").limit(labelled)
    chosen = F.broadcast(common.saved(chosen, "quality-sample"))  # at most `labelled` rows
    rows = measured(docs)
    first = F.min_by(F.struct("x", "codes", "y", "key"), "mark").alias("row")
    sample = rows.join(chosen, "doc_id").groupBy("doc_id").agg(first).select("doc_id", "row.*").toArrow().sort_by("key")
    if not sample.num_rows:
        return None
    views = views_of(*(sample[c].combine_chunks() for c in ("x", "codes")))
    ids = sample["doc_id"].to_numpy()
    return co_trained(*views, sample["y"].to_numpy(), sample["key"].to_numpy(), lambda now: taught(rows, ids, now))


def _fields(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def judged(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """model.scores of a batch with _FIELDS in front."""
    text, codes = features(batch)
    return model.scores(text.astype(float), metadata_view(codes))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, text_score, metadata_score, kept per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.slices(batches):
            both, a, b = judged(m, batch) if m else (np.ones(batch.num_rows),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (both, a, b, both >= (m.cut if m else 0.0)))], ["doc_id", "score", "text_score", "metadata_score", "kept"])

    return _fields(docs).mapInArrow(score, "doc_id long, score double, text_score double, metadata_score double, kept boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model keeps."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield batch.filter(pa.array(judged(shared.value, batch.select(_FIELDS))[0] >= shared.value.cut))

    return docs.mapInArrow(keep, docs.schema)
