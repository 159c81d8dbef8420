"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random ±1 vector (fixed by its symbol). A trigram is the product of its first
letter's vector rotated twice, its second's rotated once and its third's; a text is the sum of
its trigrams' vectors, and so is a language, over all its learning texts, each text with the same
weight. A text gets the language whose vector, less the mean of all languages' vectors, has the
largest cosine with the text's, less that same mean.

Letters are lower-cased; runs of other characters count as one gap, marks belong to their letters.
The letters a to z and those of Latin-1 have symbols of their own, all others share 960. Learning
adds up the texts' vectors as whole numbers, in steps of 2 ** -24 of a text's weight, so it gives the
same profiles however the rows are dealt out. WIDTH numbers a language reach the driver.

Cases: a null text, or one without letters (marks alone are none), is `und` with score 0; rows
without a language teach nothing, and where no row teaches, all are `und`; a text is used whole, however
long; ties go to the smaller language name; a null doc_id is kept; repeated rows teach and are
scored each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomlake.llm import common

SYMBOLS, WIDTH, UND, WEIGHT = 1024, 1024, "und", 1 << 24
#: Symbols whose trigrams a worker keeps the vectors of: gap, a to z, Latin-1.
KEPT = 64
#: Texts scored together: bounds the dense block of trigram counts.
BLOCK = 96
_PLACE: list[np.ndarray] = []


#: Set beside the symbol of letters, not of marks.
LETTER = 1 << 15


def symbol(c: str) -> int:
    """0 for a gap, 1 to 26 for a to z, 27 to 59 for Latin-1, the rest shared by other letters and marks."""
    if unicodedata.category(c)[0] not in "LM":
        return 0
    low = c.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    return ord(low) - 0xDF + 27 if 0xDF <= ord(low) <= 0xFF else KEPT + zlib.crc32(low.encode("utf-8", "surrogatepass")) % (SYMBOLS - KEPT)


def symbol_table() -> np.ndarray:
    """Symbol of each code point, with LETTER where it is one."""
    if not _PLACE:
        _PLACE.append(np.array([symbol(c) | (LETTER if unicodedata.category(c)[0] == "L" else 0) for c in map(chr, range(0x110000))], np.uint16))
    return _PLACE[0]


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of a whole text; none if it has no letters."""
    s = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not (s & LETTER).any():
        return np.zeros(0, np.int32)
    s = np.concatenate([[0], s & (LETTER - 1), [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def letters(width: int) -> np.ndarray:
    """The ±1 vectors of all symbols."""
    return np.random.default_rng(20240501).choice(np.array([-1, 1], np.int8), (SYMBOLS, width))


def bound(codes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, one row each, from those of the symbols."""
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return first[codes // SYMBOLS**2] * second[codes // SYMBOLS % SYMBOLS] * base[codes % SYMBOLS]


class TrigramVectors:
    """The vectors of trigrams; those of KEPT symbols that were seen by this worker are made once each."""

    def __init__(self, width: int = WIDTH):
        self.base, self.row, self.made, self.n = letters(width), np.full(KEPT**3, -1, np.int32), np.zeros((4096, width), np.int8), 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        x, y, z = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        kept = np.maximum(np.maximum(x, y), z) < KEPT
        place = ((x * KEPT + y) * KEPT + z)[kept]
        fresh = self.row[place] < 0
        new = codes[kept][fresh]
        if len(new):
            while self.n + len(new) > len(self.made):
                self.made = np.concatenate([self.made, np.zeros_like(self.made)])
            self.row[place[fresh]] = np.arange(self.n, self.n + len(new))
            self.made[self.n : self.n + len(new)] = bound(new, self.base)
            self.n += len(new)
        out = np.empty((len(codes), self.base.shape[1]), np.float32)
        out[kept] = self.made[self.row[place]]
        if not kept.all():
            out[~kept] = bound(codes[~kept], self.base)
        return out


_ROWS: dict[int, TrigramVectors] = {}


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in learning."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def profiles(docs: DataFrame, width: int = WIDTH) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their bundled vectors, from the rows (text, lang) that both have."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _ROWS.setdefault(width, TrigramVectors(width))
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            langs = batch.column(1).to_pylist()
            for start, sizes, bundle, total in sums_of(batch.column(0).to_pylist(), cache):
                whole = np.rint(bundle * (WEIGHT / np.maximum(total, 1))[:, None]).astype(np.int64)
                for i in np.flatnonzero(sizes).tolist():
                    own = sums.setdefault(langs[start + i], np.zeros(width, np.int64))
                    own += whole[i]
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * width, pa.string()), pa.array(np.arange(width, dtype=np.int32)), pa.array(own)], ["lang", "at", "sum"])

    learnt = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = learnt.mapInArrow(tally, "lang string, at int, sum long").groupBy("lang", "at").agg(F.sum("sum").alias("sum")).toPandas()
    names = sorted(sums["lang"].unique())
    out = np.zeros((len(names), width))
    for k, name in enumerate(names):
        out[k] = sums[sums["lang"] == name].sort_values("at")["sum"].to_numpy(float)
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def sums_of(texts: list[str | None], cache: TrigramVectors) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of texts: where the block starts, each text's number of different trigrams, its sum of vectors, its number of trigrams."""
    for start in range(0, len(texts), BLOCK):
        grams = [counted(trigrams(t)) if t else (np.zeros(0, np.int32),) * 2 for t in texts[start : start + BLOCK]]
        sizes = np.array([len(c) for c, _ in grams])
        if not sizes.any():
            continue
        union = np.unique(np.concatenate([c for c, _ in grams]))
        bundle = np.zeros((len(grams), cache.base.shape[1]))
        # Whole numbers: single precision is exact below 2 ** 24, and no block is wide.
        for a in range(0, len(union), 8192):
            part = union[a : a + 8192]
            block = np.zeros((len(grams), len(part)), np.float32)
            for i, (codes, n) in enumerate(grams):
                low, high = np.searchsorted(codes, [part[0], part[-1] + 1])
                block[i, np.searchsorted(part, codes[low:high])] = n[low:high]
            bundle += block @ cache.rows(part)
        yield start, sizes, bundle, np.array([n.sum() for _, n in grams])


def bundles(texts: list[str | None], cache: TrigramVectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By blocks of texts: where the block starts, each text's number of different trigrams, its unit vector."""
    for start, sizes, bundle, _ in sums_of(texts, cache):
        yield start, sizes, (bundle / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def score_texts(texts: list[str | None], names: list[str], vectors: np.ndarray, cache: TrigramVectors) -> tuple[list[str], list[float]]:
    """Language and score (cosine, brought to 0 to 1) of each text."""
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    if not names:
        return langs, scores
    mean = vectors.mean(axis=0) if len(names) > 1 else np.zeros(vectors.shape[1])
    centred = vectors - mean
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    for start, sizes, bundle in bundles(texts, cache):
        bundle = bundle - mean.astype(np.float32)
        bundle /= np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-12)
        cosines = bundle @ centred.T
        best = cosines.argmax(axis=1)
        for i in np.flatnonzero(sizes):
            langs[start + i], scores[start + i] = names[best[i]], float(np.clip((1 + cosines[i, best[i]]) / 2, 0, 1))
    return langs, scores


def identified(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """docs (any columns, with text) with lang_pred and score appended; those names of its own go."""
    shared = docs.sparkSession.sparkContext.broadcast((names, vectors))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _ROWS.setdefault(WIDTH, TrigramVectors(vectors.shape[1]))
        for batch in common.slices(batches):
            langs, scores = score_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), *shared.value, cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predict, schema)


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Texts with alike numbers of different trigrams: the whole part of the logarithm to base 2."""
    return np.log2(np.maximum(sizes, 1)).astype(int)


def cuts(docs: DataFrame, names: list[str], vectors: np.ndarray, low: float, share: float) -> np.ndarray:
    """The least cosine of a text in a learned language, by size class.

    It is `share` of the `low` quantile of the learning texts' cosines with their own language's
    vector, not less any mean: those of other languages and of junk lie near 0, those of short texts
    are lower than those of long ones. A class without learning texts has that of the next smaller
    one, or none. What reaches the driver is a histogram in steps of 0.001.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, vectors.astype(np.float32)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        cache = _ROWS.setdefault(WIDTH, TrigramVectors(vectors.shape[1]))
        for batch in common.slices(batches):
            own = np.array([names.index(lang) if lang in names else 0 for lang in batch.column(1).to_pylist()])
            for start, sizes, bundle in bundles(batch.column(0).to_pylist(), cache):
                cosines = (bundle * vectors[own[start : start + len(sizes)]]).sum(axis=1)[sizes > 0]
                place, n = np.unique(np.column_stack([size_class(sizes[sizes > 0]), np.floor(cosines * 1000).astype(int)]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(n)], ["size", "step", "n"])

    learnt = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    found = learnt.mapInArrow(tally, "size long, step long, n long").groupBy("size", "step").agg(F.sum("n").alias("n")).toPandas()
    out, last = np.full(size_class(np.array([SYMBOLS**3]))[0] + 1, -1.0), -1.0
    for size in range(len(out)):
        part = found[found["size"] == size].sort_values("step")
        if len(part):
            total = part["n"].cumsum().to_numpy()
            at = part["step"].to_numpy()[np.searchsorted(total, int(low * total[-1]), side="right")] / 1000
            last = min(at, share * at)
        out[size] = last
    return out


def spoken(docs: DataFrame, names: list[str], vectors: np.ndarray, least: np.ndarray) -> DataFrame:
    """The rows of docs whose cosine with the best language's vector is that of their size class in `least` at least."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors.astype(np.float32), least))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, least = shared.value
        cache = _ROWS.setdefault(WIDTH, TrigramVectors(vectors.shape[1]))
        for batch in common.slices(batches):
            kept = np.zeros(batch.num_rows, bool)
            if len(vectors):
                for start, sizes, bundle in bundles(batch.column(batch.schema.get_field_index("text")).to_pylist(), cache):
                    kept[start : start + len(sizes)] = (sizes > 0) & ((bundle @ vectors.T).max(axis=1) >= least[size_class(sizes)])
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, vectors = profiles(rows.where(~held_out(F.col("doc_id"))))
    return identified(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), names, vectors).drop("text")


def accuracy(docs: DataFrame, found: DataFrame) -> pd.DataFrame:
    """Held-out rows by language: how many, and how many are right."""
    truth = docs.select("doc_id", "lang").where(F.col("lang").isNotNull())
    return found.where("held_out").join(truth, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long")).alias("right")).toPandas()
