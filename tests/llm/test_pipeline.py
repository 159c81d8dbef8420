import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geomlake.llm import language_id, quality, word_ids
from geomlake.llm.queries import WORD_BPE
from tests.llm.test_near_dups import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted():
    rng = random.Random(8)
    words = {"en": ["the", "house", "is", "with", "which", "through", "thing", "over"], "de": ["der", "und", "nicht", "schön", "über", "können", "zwischen", "auch"]}
    rows = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(60))
        rows.append([text if i % 6 else "$$$ | %%% | " * 20 + text[:40], lang, "s", int(i % 6 > 0)])
    rows += [[rows[7][0] + " the", "en", "s", 1], [rows[7][0], "en", "s", 1], [None, "en", "s", None], ["123 456", "en", None, None], ["", None, None, None]]
    return [(i, r[0], r[1], r[2], len(r[0] or ""), r[3]) for i, r in enumerate(rows)]


def test_rows_equal_brute_force(spark, tmp_path):
    rows = planted()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(stages) == ["language", "quality", "near_duplicates", "packing"]

    spoken = stages["language"](spark, docs, str(tmp_path))
    names, vectors = language_id.profiles(docs)
    langs, scores = language_id.score_texts([r[1] for r in rows], names, vectors, language_id.TrigramVectors())
    want = [r[0] for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= 0.5]
    assert sorted(r["doc_id"] for r in spoken.collect()) == want and spoken.columns == COLUMNS
    assert {r[0] for r in rows[:242]} <= set(want) and not {242, 243, 244} & set(want)

    kept = stages["quality"](spark, spoken, str(tmp_path))
    assert kept.columns == COLUMNS and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows[:242] if r[5]}

    one = stages["near_duplicates"](spark, kept, str(tmp_path))
    want = [d for d, _, c, _ in brute([(r[0], r[1]) for r in rows[:242] if r[5]], 5) if d == c]
    assert one.columns == COLUMNS and sorted(r["doc_id"] for r in one.collect()) == sorted(want) and 240 not in want

    library = word_ids.WordTokenizer(public_tokenizers.path(WORD_BPE)).library
    ids = {d: np.array([*library.encode(rows[d][1], add_special_tokens=False).ids, 1], "<u4") for d in want}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert (t, p) in ((s, o + n), (s + 1, 0))


def test_an_unlearned_language_and_letter_junk_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (40, 80, 300, 2000)]
    junk += ["xqzj " * 80, "Это русский текст для проверки языка документа и его качества, он достаточно длинный. " * 2]
    mixed = mixed.unionByName(spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(junk)], mixed.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, mixed, "").collect()}
    clean = {r["doc_id"] for r in docs.where("lang != 'fr'").collect()}
    french = {r["doc_id"] for r in docs.where("lang = 'fr' AND n_chars > 400").collect()}
    assert clean <= kept and not any(d < 0 for d in kept)
    assert len(french) > 50 and len(french & kept) <= 0.05 * len(french)


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, kept string"
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "the words of a text", "en", None, None, "a", "b", "c")] * 2 + [(None, "no id here", None, "s", 3, None, None, None), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "k", "s", "k")]
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert (got.columns == docs.columns) == (name != "packing") and got.count() > 0
    if name == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "3", "None"]



def test_the_quality_sample_is_bounded():
    assert quality.LABELLED <= 20_000
