import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomlake.llm import language_id, quality

SF = "/root/testdata/sf0.1"


def test_trigrams_see_whole_texts():
    assert language_id.trigrams("").size == language_id.trigrams("12 !? \n").size == 0
    a = language_id.trigrams("Ab")
    assert a.tolist() == [(0 * 1024 + 1) * 1024 + 2, (1 * 1024 + 2) * 1024 + 0]
    assert language_id.trigrams("x" * 100_000).size == 100_000
    assert language_id.trigrams("\u0301\u0302 \u0903").size == 0 and language_id.trigrams("e\u0301").size == 2
    assert [language_id.symbol(c) for c in "azßÿ éÉ"] == [1, 26, 27, 59, 0, 37, 37] and len({language_id.symbol(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя"}) > 28


def plain_language(rows):
    """The whole query in plain Python and exact fractions; rows: doc_id, text, lang."""
    base = language_id.letters(language_id.WIDTH).astype(int)

    def vector(text):
        text = text or ""
        if not any(unicodedata.category(c)[0] == "L" for c in text):
            return None
        letters = [language_id.symbol(c) for c in text]
        flat = [0] + [s for i, s in enumerate(letters) if s or (i and letters[i - 1])] + [0] * bool(letters[-1])
        return sum(n * np.roll(base[x], 2) * np.roll(base[y], 1) * base[z] for (x, y, z), n in Counter(zip(flat, flat[1:], flat[2:])).items()), len(flat) - 2

    sums = {}
    for doc_id, text, lang in rows:
        if lang is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2) and (v := vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v[0] / v[1]
    protos = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    mean = sum(protos.values()) / len(protos)
    out = []
    for doc_id, text, _ in rows:
        if (v := vector(text)) is None:
            out.append((doc_id, "und", 0.0))
            continue
        own = v[0] / np.linalg.norm(v[0]) - mean
        cosines = {lang: own @ (p - mean) / np.linalg.norm(own) / np.linalg.norm(p - mean) for lang, p in protos.items()}
        best = max(cosines, key=cosines.get)
        out.append((doc_id, best, (1 + cosines[best]) / 2))
    return out


def test_the_language_query_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(-1, "\u0301\u0302 12", "en"), (-2, None, "fr"), (-3, "Это русский текст ё", "en"), (None, "das und die", "de"), (-4, "x" * 2_000_000 + " the end", None), (-1, "twice the id", "en")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.languages(docs).collect()]
    order = lambda x: (str(x[0]), x[1], x[2])
    for g, w in zip(sorted(got, key=order), sorted(plain_language(rows), key=order), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-5)


def test_language_accuracy_and_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.languages(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    by_lang = language_id.accuracy(docs, found)
    assert by_lang["right"].sum() / by_lang["n"].sum() > 0.985
    shuffled = language_id.languages(docs.repartition(7))
    assert sorted(map(tuple, shuffled.select("doc_id", "lang_pred").collect())) == sorted((r["doc_id"], r["lang_pred"]) for r in rows)


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score double"
    rows = [(i, t, lang, "clash", 9.0) for i, t, lang in [(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr"), (2, None, "en"), (3, "", None), (4, "12 34", "fr"), (None, "the dog", "en"), (5, "das", None), (0, "the cat and the dog", "en")]]
    got = language_id.languages(spark.createDataFrame(rows, schema)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and by[None]["held_out"] is False
    none = language_id.languages(spark.createDataFrame([(1, "text", None, None, None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
    assert language_id.languages(spark.createDataFrame([], schema)).count() == 0


def test_quality_accuracy_on_rows_it_did_not_see(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.col("doc_id") % 3 == 0
    model = quality.learned(docs, labels.where(~unseen))
    rows = quality.scored(docs, model).join(labels.where(unseen), "doc_id").toPandas()
    assert ((rows["score"] > 0.5) == (rows["quality"] == 1)).mean() > 0.98
    assert rows.loc[rows["quality"] == 1, "kept"].mean() > 0.995 and rows.loc[rows["quality"] == 0, "kept"].mean() < 0.1
    again = quality.scored(docs.repartition(5), quality.learned(docs.repartition(3), labels.where(~unseen)))
    assert again.agg(F.sum("score")).first()[0] == pytest.approx(quality.scored(docs, model).agg(F.sum("score")).first()[0], rel=1e-9)


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(1)
    y = (rng.random(1500) < 0.6).astype(float)
    views = [np.column_stack([y * 3 + rng.standard_normal(1500), rng.standard_normal((1500, 30))]) for _ in range(2)]
    known = np.arange(1500) < 120
    pool = lambda now: quality.handed(now, tuple(v[~known] for v in views))
    alone, taught = (quality.co_trained(views[0][known], views[1][known], y[known], np.arange(120), pool, n) for n in (0, 6))
    right = [((m.scores(*views)[0] > 0.5) == (y == 1))[~known].mean() for m in (alone, taught)]
    assert right[1] > right[0] and right[1] > 0.9


def plain_quality(rows, labels):
    """The whole query row by row: own features, Newton steps and pseudo-labels in loops; rows: doc_id, text, lang, source, n_chars, hash."""

    def view_a(text):
        return np.array(quality.text_view(text or ""), np.float16).astype(float)

    def view_b(lang, source, n):
        out = [0.0] * (quality.LANGS + quality.SOURCES + quality.SIZES)
        out[0 if lang is None else 1 + zlib.crc32(lang.encode()) % (quality.LANGS - 1)] = 1.0
        out[quality.LANGS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (quality.SOURCES - 1))] = 1.0
        out[quality.LANGS + quality.SOURCES + (0 if n is None or n < 0 else min(quality.SIZES - 1, len(bin(n + 1)) - 2))] = 1.0
        return np.array(out)

    xs = [np.array([view_a(r[1]) for r in rows]), np.array([view_b(*r[2:5]) for r in rows])]
    y, key = np.array([labels.get(r[0], np.nan) for r in rows]), np.array([r[5] for r in rows])
    known = ~np.isnan(y)
    fit, cal, mix = known & (key % 4 >= 2), known & (key % 4 == 0), known & (key % 4 == 1)

    def newton(z, target, weight, w, steps, above=False):
        penalty = np.array([1.0] * (z.shape[1] - 1) + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            first = sum(weight[i] * (p[i] - target[i]) * z[i] for i in range(len(z))) + penalty * w
            o = np.maximum(np.abs(np.clip(z @ w, -30, 30)), 1e-6)
            curve = [np.tanh(o[i] / 2) / (2 * o[i]) if above else max(p[i] * (1 - p[i]), 1e-6) for i in range(len(z))]
            second = sum(weight[i] * curve[i] * np.outer(z[i], z[i]) for i in range(len(z))) + np.diag(penalty)
            step = np.clip(np.linalg.solve(second, first), -4, 4)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def regression(x, target):
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = newton(z, target, np.ones(len(z)), np.zeros(z.shape[1]), 25)
        return lambda v: np.clip(np.column_stack([(v - mean) / scale, np.ones(len(v))]) @ w, -30, 30)

    zs = [np.column_stack([(x - x[fit].mean(axis=0)) / np.maximum(x[fit].std(axis=0), 1e-3), np.ones(len(x))]) for x in xs]
    ws = [newton(z[fit], y[fit], np.ones(fit.sum()), np.zeros(z.shape[1]), 25) for z in zs]
    for _ in range(quality.ROUNDS):
        odds = [np.clip(z @ w, -30, 30) for z, w in zip(zs, ws, strict=True)]
        odds = [regression(o[cal][:, None], y[cal])(o[:, None]) for o in odds]
        new = []
        for me, other in ((0, 1), (1, 0)):
            sure = np.array([1.0 if o >= np.log(0.97 / 0.03) else 0.0 if o <= -np.log(0.97 / 0.03) else np.nan for o in odds[other]])
            sure[known] = np.nan
            target, weight = np.where(fit, y, sure), np.where(fit, 1.0, 0.0)
            for c in (0, 1):
                weight[sure == c] = min(1.0, (y[fit] == c).sum() / max(1, (sure == c).sum()))
            use = weight > 0
            new.append(newton(zs[me][use], target[use], weight[use], ws[me], 1, True))
        ws = new
    odds = [np.clip(z @ w, -30, 30) for z, w in zip(zs, ws, strict=True)]
    odds = np.stack([regression(o[cal][:, None], y[cal])(o[:, None]) for o in odds], axis=1)
    score = 1 / (1 + np.exp(-regression(odds[mix], y[mix])(odds)))
    return score, score >= min(0.5, np.quantile(score[(cal | mix) & (y == 1)], 1 - quality.PASS))


def test_the_quality_query_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 5 <> 1")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), F.xxhash64(F.col("doc_id").cast("long"))).collect()]
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    score, kept = plain_quality(rows, known)
    got = {r["doc_id"]: r for r in quality.scored(docs, quality.learned(docs, labels)).collect()}
    assert len(got) == len(rows)
    assert [got[r[0]]["score"] for r in rows] == pytest.approx(score.tolist(), abs=1e-6)
    assert [got[r[0]]["kept"] for r in rows] == kept.tolist()


def test_the_sample_is_the_same_however_rows_lie(spark):
    rows = [(i % 150, ("plain words of row " if i % 2 else "$ % & ") * 5 + str(i), "en", "s", 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    a, b = (quality.learned(docs.repartition(n), labels) for n in (1, 7))
    assert a.cut == pytest.approx(b.cut, abs=1e-9) and all(np.allclose(v.weights, w.weights, atol=1e-8) for v, w in zip(a.views, b.views, strict=True))


def test_quality_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, y string, key string"
    rows = [(i, t, None, None, n, "s", "k", "y", "key") for i, t, n in [(1, "good text", 9), (2, None, None), (3, "", -5), (None, "x", 1), (1, "good text", 9), (4, "w " * 50_000, 100_000)]]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, quality.learned(docs, labels)).collect()
    assert len(got) == len(rows) and all(r["kept"] and r["score"] == 1 for r in got)
    many = spark.createDataFrame([(i, "$ % & " * 9 if i % 2 else f"plain words of row {i}", "en", "s", 50, "s", "k", "y", "key") for i in range(200)], schema)
    model = quality.learned(many, spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id long, quality int"))
    assert {r["doc_id"]: r["kept"] for r in quality.scored(many, model).collect()} == {i: i % 2 == 0 for i in range(200)}
    assert len(quality.scored(docs, model).collect()) == len(rows)
    assert quality.scored(docs.limit(0), model).count() == 0 and quality.learned(docs.limit(0), labels) is None
