"""Ranks of pairs without a table of pairs, against plain ranks, with ties and labels of several tasks."""

import numpy as np
import pandas as pd
import pytest

from geomlake.operators import blocked, ranking
from geomlake.plans import catalog, registry
from geomlake.sources import store
from tests.compare import differences

QUERIES = catalog.queries()
TABLELESS = ["rdm_spearman", "corr_to_t", "ordinal_rank", "full_sheet_pair", "grouped_rsa", "parcel_rsa", "partial_corr_suite", "partial_rsa_1", "partial_rsa_2", "perm_shift", "rdm_label_summary", "embedding_quality", "rdm_kendall", "searchlight_rsa"]


def coarse(x, y):
    """Distances of few values, so of many ties."""
    return np.round(blocked.squared(x, y) * 2)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 700)
    monkeypatch.setattr(ranking, "BAND", 5)


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("method", ["average", "min", "ordinal"])
def test_parts_own_every_pair_once_with_exact_ranks(small, parts, method):
    rng = np.random.default_rng(3)
    ids, x = rng.permutation(53) * 7, rng.integers(0, 2, (53, 4)).astype(float)
    order = np.argsort(ids)
    d = pd.Series([coarse(x[[i]], x[[j]])[0, 0] for a, i in enumerate(order) for j in order[:a]])
    want = d.rank(method={"ordinal": "first"}.get(method, method)).to_numpy()
    held = [ranking.Pairs(ids, x, k, parts) for k in range(parts)]
    assert np.concatenate([p.ranks(coarse, method)[0] for p in held]) == pytest.approx(want)
    i, j = (np.concatenate(c) for c in zip(*(p.names() for p in held)))
    assert [*zip(i, j)] == [(ids[a], ids[b]) for k, a in enumerate(order) for b in order[:k]]
    more = np.array([0, 1377, 600, 5])
    got = held[0].ranks(coarse, "average", more)[0][-len(more) :]
    assert got == pytest.approx(d.rank().to_numpy()[more])


@pytest.mark.parametrize("own", [40, 10**6])
def test_correlations_and_shifts_over_several_tasks(spark, own, monkeypatch):
    monkeypatch.setattr(ranking, "OWN", own)
    rng = np.random.default_rng(5)
    data = [(int(v), int(v) % 3, [float(c) for c in rng.integers(0, 3, 6)]) for v in range(60)]
    rows = spark.createDataFrame(data, "vec_id long, label int, x array<double>")
    measures = {"a": blocked.band(coarse, 1, 3), "b": blocked.band(coarse, 4, 6)}
    got = {r["label"]: r for r in ranking.correlations(rows, measures, [("a", "b")]).collect()}
    moved = {(r["label"], r["off"]): r["r_b"] for r in ranking.shifted(rows, measures["a"], {"b": measures["b"]}, [0, 7, 400]).collect()}
    for label in range(3):
        x = np.array([v for _, k, v in data if k == label])
        at = np.tril_indices(len(x), -1)
        a, b = (pd.Series(m(x, x)[at]).rank().to_numpy() for m in measures.values())
        assert got[label]["n"] == len(a) and got[label]["a_b"] == pytest.approx(np.corrcoef(a, b)[0, 1])
        for off in (0, 7, 400):
            assert moved[label, off] == pytest.approx(np.corrcoef(a, np.roll(b, -off))[0, 1])


@pytest.mark.parametrize("name", TABLELESS)
def test_no_table_of_pairs_is_stored(spark, monkeypatch, name):
    def refuse(df, what):
        raise AssertionError(f"{what}: stored")

    monkeypatch.setattr(store, "stored", refuse)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_spearman_of_least_ranks_equals_sql_with_ties(spark, tmp_path):
    rng = np.random.default_rng(7)
    data = [(v, [float(c) for c in rng.integers(0, 2, 64) * (v % 7 > 3)], v % 2) for v in range(60)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).toPandas().to_parquet(tmp_path / "embeddings.parquet")
    assert not differences(QUERIES["rdm_spearman"](spark, str(tmp_path)), registry.SQL["rdm_spearman"], str(tmp_path))


def test_inversions_equal_pairs():
    from geomlake.functions import special

    for seed in range(20):
        y = np.random.default_rng(seed).integers(0, 1 + 3 * seed, 5 * seed)
        assert special.inversions(y) == sum(int(y[a] > y[b]) for b in range(len(y)) for a in range(b))


@pytest.mark.parametrize("own", [40, 10**6])
def test_kendall_neighbours_and_searchlights_over_several_tasks(spark, own, monkeypatch):
    from geomlake.functions import special
    from geomlake.operators import kernels

    monkeypatch.setattr(ranking, "OWN", own)
    rng = np.random.default_rng(9)
    data = [(v, v % 2, [float(c) for c in rng.standard_normal(6).round(v % 2)]) for v in range(64)]
    rows = spark.createDataFrame(data, "vec_id long, label int, x array<double>")
    a, b = blocked.squared, blocked.band(coarse, 1, 3)
    tau = {r["label"]: r["tau"] for r in ranking.kendall(rows, a, b).collect()}
    near = {r["label"]: r for r in ranking.kept_neighbours(rows, a, blocked.band(a, 1, 3), 5).collect()}
    lights = {(r["label"], r["centre"]): r["value"] for r in ranking.searchlights(rows, {0: [0, 1, 2], 1: [2]}, [3, 4, 5], 1).collect()}
    for label in range(2):
        x = np.array([v for _, k, v in data if k == label])
        at = np.tril_indices(len(x), -1)
        assert tau[label] == pytest.approx(special.kendall_tau_b(a(x, x)[at], b(x, x)[at]))
        n, want = len(x), kernels.embedding_quality(x, x[:, :3], 5)
        assert near[label]["n"] == n
        if label:  # few ties
            got = [1 - 2 / (n * 5 * (2 * n - 16)) * near[label][c] for c in ("trust", "continuity")]
            assert got == pytest.approx([want["trust"], want["continuity"]])
        d = [pd.Series(blocked.correlation(x[:, f], x[:, f])[at].round(12)).rank().to_numpy() for f in ([0, 1, 2], [3, 4, 5])]
        assert lights[label, 0] == pytest.approx(np.corrcoef(*d)[0, 1]) and lights[label, 1] == 0


def test_ordinal_ranks_equal_sql_on_copies_and_rows_without_variation(spark, tmp_path):
    rng = np.random.default_rng(11)
    few = np.concatenate([rng.standard_normal((120, 64)), np.full((2, 64), 0.5)])
    data = [(k * 1000 + v, [float(c) for c in row], 4) for k in range(3) for v, row in enumerate(few)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).toPandas().to_parquet(tmp_path / "embeddings.parquet")
    assert not differences(QUERIES["ordinal_rank"](spark, str(tmp_path)), registry.SQL["ordinal_rank"], str(tmp_path))


@pytest.mark.parametrize("length", [1, 6, 64, 300])
@pytest.mark.parametrize("trusted", [True, False])
def test_fused_products_have_the_bits_of_fused_additions(monkeypatch, length, trusted):
    import math

    from geomlake.operators import fused

    if not trusted:
        monkeypatch.setattr(fused, "tiles_agree", lambda length: False)
    rng = np.random.default_rng(13)
    x, y = rng.standard_normal((21, length)) * 10.0 ** rng.integers(-6, 6, (21, 1)), rng.standard_normal((33, length))

    def plain(a, b):
        total = 0.0
        for p, q in zip(a.tolist(), b.tolist()):
            total = math.fma(p, q, total)
        return total

    assert (fused.products(x, y) == [[plain(a, b) for b in y] for a in x]).all()


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("stretch", [90, 4000])
def test_searchlights_sort_all_pairs_a_stretch_at_a_time(monkeypatch, parts, stretch):
    monkeypatch.setattr(ranking, "STRETCH", stretch)
    rng = np.random.default_rng(15)
    x = rng.integers(0, 3, (60, 6)).astype(float)
    x[10:25] = x[10]  # 105 pairs at distance 0
    x[30:] += rng.standard_normal((30, 6))
    ids, at = np.arange(60), np.tril_indices(60, -1)
    near, seed = [0, 1, 4, 5], [2, 3, 4]
    a, b = (2 * pd.Series(blocked.correlation(x[:, f], x[:, f])[at].round(12)).rank().to_numpy() - len(at[0]) - 1 for f in (near, seed))
    total = 0.0
    for part in range(parts):
        lights = ranking.Lights(ranking.Pairs(ids, x, part, parts, 200))
        assert lights.rank_model(seed) == pytest.approx(b @ b)
        seen, keys = [], lights.keys
        lights.keys = lambda z, band: seen.append(band) or keys(z, band)
        p, q = lights.against_model(near)
        assert q == pytest.approx(a @ a)
        total += p
        if stretch == 4000:
            assert seen == lights.pairs.bands  # each distance once, where a task went over all pairs for each of OWN
    assert total == pytest.approx(a @ b)


def test_searchlights_of_several_tasks_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LIGHT", 300)
    sf = "/root/testdata/sf0.001"
    assert not differences(QUERIES["searchlight_rsa"](spark, sf), registry.SQL["searchlight_rsa"], sf)
