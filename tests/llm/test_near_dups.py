import random
import re

import numpy as np
import pytest

from geomlake.llm import near_dups
from geomlake.llm.common import LOWER
from geomlake.llm.components import components


def brute(rows, k, percent=80):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(len(rows)):
        low.setdefault(find(i), []).append(rows[i][0])
    return sorted(((d, len(s), c, d == c or d is None) for (d, _), s, c in ((r, s, None if r[0] is None else min(low[find(i)])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))), key=str)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            copy = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    hot = rng.choices(words, k=120)
    rows += [" ".join(rng.choice(words) if rng.random() < 0.04 else w for w in hot) for _ in range(120)]
    rows += [None, "", "  \t", "One", "one", "a b", "a b", "x " * 2000, "É é", "a\x00b", "v\x0bt\x0cf"]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return [*rows, (None, rows[0][1]), (rows[5][0], rows[5][1])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "x") for d, t in rows], "doc_id long, text string, key string, grp string")


@pytest.mark.parametrize(("k", "cluster"), [(2, near_dups.CLUSTER), (5, near_dups.CLUSTER), (2, 3000)])
def test_equals_brute_force(spark, k, cluster):
    rows = corpus()
    got = sorted((tuple(r) for r in near_dups.near_duplicates(frame(spark, rows), k, cluster=cluster).collect()), key=str)
    assert got == brute(rows, k)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in near_dups.near_duplicates(docs, 2).collect()), key=str)
    assert got == brute(rows, 2)


def test_whole_table_equals_sql(spark):
    from tests.compare import differences

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert not differences(near_dups.near_duplicates(docs, 2), near_dups.oracle(), "/root/testdata/sf0.001")


def test_empty_and_unlinked(spark):
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0
    got = near_dups.near_duplicates(frame(spark, [(1, "a b c"), (2, None)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize(("node", "leaf", "grid"), [(near_dups.NODE, 4, 300), (8, 2, 1000)])
def test_big_nodes_branch_and_large_clusters_are_cut(spark, node, leaf, grid):
    rows = corpus()
    got = sorted((tuple(r) for r in near_dups.near_duplicates(frame(spark, rows), 2, node=node, leaf=leaf, grid=grid).collect()), key=str)
    assert got == brute(rows, 2)


def test_recall_by_depth():
    """Pairs at the threshold among many other sets that share a frequent first token, by one tree and the depth reached."""
    rng = np.random.default_rng(4)
    found, depths = [], []
    for trial in range(60):
        shared = rng.integers(0, 256, 64, dtype=np.uint8)
        tokens = rng.integers(0, 256, (600, 64), dtype=np.uint8)
        common = rng.random((600, 64)) < 0.5
        tokens[common] = np.broadcast_to(shared, tokens.shape)[common]
        tokens[0] = tokens[599]
        changed = rng.random(64) < 0.2
        tokens[0, changed] = rng.integers(0, 256, changed.sum())
        stars = list(near_dups.visited(np.arange(600), np.arange(600), tokens, np.full(600, 100), trial % near_dups.TREES, 0.8, leaf=4))
        depths.append(max(d for *_, d in stars))
        top = list(range(600))
        for a, b, _ in stars:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                low, high = sorted((top[x], top[y]))
                top = [low if t == high else t for t in top]
        found.append(top[0] == top[599])
    deep = max(depths)
    # One tree, the first node given: its own 0.8 is not part of the odds.
    assert deep >= 3 and np.mean(found) > 1 - near_dups.missed(deep - 1, before=-1, trees=1) - 0.1
    assert near_dups.missed(0) < 1.1e-14 and near_dups.missed(4) < 1e-12 and near_dups.missed(1, before=1) < 6e-9


@pytest.mark.parametrize("seed", range(2))
def test_rows_that_share_an_id_are_compared_by_their_texts(spark, seed):
    rng = random.Random(1)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(3))
    rows = [(5, a), (5, b), (9, b + " z"), (3, a + " y"), (5, c), (5, c), (7, c), (2, a + " x y"), (9, "other words that stand alone here")]
    random.Random(seed).shuffle(rows)
    docs = frame(spark, rows).repartition(3)
    got = sorted((tuple(r) for r in near_dups.near_duplicates(docs, 2).collect()), key=str)
    assert got == brute(rows, 2)
    kept = sorted((r["doc_id"], r["text"]) for r in near_dups.one_each(docs, 2).collect())
    assert kept == sorted([(2, a + " x y"), (5, b), (5, c), (9, "other words that stand alone here")])


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = near_dups.one_each(docs, 5)
    assert kept.columns == docs.columns
    smallest = sorted({(d, n > 0) for d, n, c, k in brute(rows, 5) if k and d is not None})
    got = sorted((r["doc_id"], bool((r["text"] or "").strip())) for r in kept.collect() if r["doc_id"] is not None)
    assert got == smallest


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
