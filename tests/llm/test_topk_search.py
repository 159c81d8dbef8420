import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from geomlake.llm import topk_search
from geomlake.llm.common import LOWER


def plain(docs: pd.DataFrame, k: int, terms: int, every: int) -> list[tuple]:
    """The same result by scoring every document; for tests."""
    texts = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t in docs["text"]]
    kept = [(int(d), c) for d, c in zip(docs["doc_id"], texts, strict=True) if pd.notna(d)]
    n, mean = len(kept), sum(sum(c.values()) for _, c in kept) / max(1, len(kept))
    df = Counter(w for _, c in kept for w in c)
    weight = {w: math.log1p((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    out = []
    for q, own in {q: c for q, c in kept if q % every == 0}.items():
        chosen = sorted((-round(tf * weight[w], 9), w) for w, tf in own.items())[:terms]
        scores = []
        for d, c in kept:
            parts = [weight[w] * c[w] * (topk_search.K1 + 1) / (c[w] + topk_search.K1 * (1 - topk_search.B + topk_search.B * sum(c.values()) / mean)) for _, w in chosen if w in c]
            if parts:
                scores.append((-round(sum(parts), 9), d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def same(df, want):
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-7)


@pytest.mark.parametrize(("shard", "queries", "k", "terms"), [(topk_search.SHARD, topk_search.QUERIES, 10, 32), (20_000, 7, 3, 500), (5_000, 4, 25, 8)])
def test_whole_table(spark, monkeypatch, shard, queries, k, terms):
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = topk_search.index(docs, shard)
    found = topk_search.search(shards, topk_search.telling_terms(docs.where("doc_id % 50 = 0"), shards, terms), k)
    same(found, plain(docs.toPandas(), k, terms, 50))


def test_a_document_asks_with_all_its_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    same(topk_search.similar(docs, F.col("doc_id") % 50 == 0), plain(docs.toPandas(), 10, None, 50))
    telling = " ".join(f"rare{i} rare{i}" for i in range(40))
    rows = [(0, f"{telling} tail end"), (1, "tail end"), (2, "other words")]
    got = topk_search.similar(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1]


def test_cases(spark):
    schema = "doc_id long, text string, term string, score string"
    rows = [(0, "one TWO two three"), (1, "two, two!"), (2, "two two"), (3, None), (4, ""), (50, None), (100, "!!!"), (None, "two"), (7, "One two two three"), (150, "É é日本 \x00 x1"), (0, "one TWO two three"), (8, "two " * 60_000)]
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], schema)
    got = topk_search.similar(docs, F.col("doc_id") % 50 == 0, k=5)
    same(got, plain(docs.toPandas(), 5, topk_search.TERMS, 50))
    assert topk_search.similar(docs.limit(0), F.col("doc_id") % 50 == 0).count() == 0


def test_documents_below_the_threshold_are_skipped(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} rare{i // 40} " + "filler " * (i % 90)) for i in range(6000)], "doc_id long, text string")
    shard = topk_search.Shard(topk_search.index(docs.coalesce(1)).first().asDict(), 40.0)
    asked = {"common": 0.1, "word3": 2.0, "rare5": 8.0}
    terms = sorted((xxhash.xxh3_64_intdigest(w) - (1 << 64 if xxhash.xxh3_64_intdigest(w) >> 63 else 0), v) for w, v in asked.items())
    query = (np.array([t for t, _ in terms]), np.array([v for _, v in terms]), -np.inf)
    ((_, ids, scores),) = shard.search([query], 3)
    assert len(ids) == 3 and {i // 40 for i in ids.tolist()} == {5}
    assert shard.read == 40 and shard.scored < 100
    # With its last score as the floor the same are found, above the first none.
    assert [i.tolist() for _, i, _ in shard.search([(*query[:2], scores[-1])], 3)] == [ids.tolist()]
    assert sum(len(i) for _, i, _ in shard.search([(*query[:2], scores[0] + 1e-6)], 3)) == 0


def test_hot_copies_and_scores_in_many_shards(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = ["the same text of a third of all rows"] * 400 + [" ".join(rng.choices(words, k=rng.choice([1, 4, 30, 120]))) for _ in range(800)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    shards = topk_search.index(docs, 3000)
    assert shards.count() == 6 and shards.agg(F.sum("n_docs")).first()[0] == 1200
    same(topk_search.search(shards, topk_search.telling_terms(docs.where("doc_id % 10 = 0"), shards), 10), plain(docs.toPandas(), 10, None, 10))


def test_shards_searched_as_one_give_what_each_gives(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 < 2").repartition(5)
    rows = [r.asDict() for r in topk_search.index(docs, 30_000).collect()]
    assert len(rows) == 5
    asked = topk_search.telling_terms(docs.where("doc_id % 20 = 0"), topk_search.index(docs)).toPandas()
    queries = [(np.array(x["term"]), np.array(x["weight"]), -np.inf) for _, x in asked.sort_values("term").groupby("query_id")]

    def best(shards, queries):
        found = [[] for _ in queries]
        for shard in shards:
            for i, ids, scores in shard.search(queries, 10):
                found[i] += zip((-scores).tolist(), ids.tolist(), strict=True)
        return [sorted(x)[:10] for x in found]

    want = best([topk_search.Shard(r, 300.0) for r in rows], queries)
    assert all(len(x) == 10 for x in want)
    one = topk_search.Shard(topk_search.joined(rows), 300.0)
    assert best([one], queries) == want
    # With the last scores as floors the same are found; so they are with postings of 64 bits.
    assert best([one], [(*q[:2], -x[-1][0]) for q, x in zip(queries, want, strict=True)]) == want
    monkeypatch.setattr(topk_search, "MANY", 0)
    assert best([topk_search.Shard(topk_search.joined(rows), 300.0)], queries) == want


def test_groups_of_shards_hold_a_bounded_number_of_documents():
    shards = [("a", 10), ("b", 20), ("c", topk_search.DOCS), ("d", 5), ("e", 5), ("f", 5), ("g", 5)]
    assert topk_search.grouped(shards, 3) == [["a", "b"], ["c"], ["d", "e", "f"], ["g"]]
    assert topk_search.grouped(shards, 1) == [[p] for p, _ in shards] and topk_search.grouped([], 3) == []


@pytest.mark.parametrize("size", [1, 4])
def test_groups_of_shards_do_not_change_the_result(spark, monkeypatch, size):
    real = topk_search.grouped
    monkeypatch.setattr(topk_search, "grouped", lambda shards, _: real(shards, size))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = topk_search.index(docs.repartition(9))
    assert shards.count() == 9
    same(topk_search.search(shards, topk_search.telling_terms(docs.where("doc_id % 50 = 0"), shards), 10), plain(docs.toPandas(), 10, None, 50))
