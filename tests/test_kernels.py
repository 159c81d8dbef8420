import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geomlake.functions import ranks, special
from geomlake.functions import vectors as V
from geomlake.operators import aggregates, geometry, graph, inference, kernels, models, signal, windows
from geomlake.sources import store, timing

RNG = np.random.default_rng(5)


def blobs():
    centres = np.array([[5, 5], [5, -5], [-5, 5], [-5, -5]], float)
    return np.concatenate([c + 0.35 * np.random.default_rng(i).standard_normal((30, 2)) for i, c in enumerate(centres)])


# Distribution functions.


@pytest.mark.parametrize(("t", "df", "p"), [(0, 5, 0.5), (2.015048, 5, 0.05), (12.7062, 1, 0.025), (-2.015048, 5, 0.95), (3.0, 1e6, 0.00134996)])
def test_t_tail(t, df, p):
    assert special.t_sf(t, df) == pytest.approx(p, rel=1e-4)


def test_fisher_tail_sums_the_hypergeometric():
    a, b, c, d = 8, 2, 1, 5
    ways = lambda k: math.comb(10, k) * math.comb(6, 9 - k)
    assert special.fisher_tail(a, b, c, d) == pytest.approx(sum(ways(k) for k in range(8, 10)) / math.comb(16, 9))


def test_kendall_equals_pairs():
    x, y = RNG.integers(0, 6, 60), RNG.integers(0, 6, 60)
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())
    assert special.kendall_tau_b(x, y) == pytest.approx(want)


def test_savgol_keeps_cubics_and_hrf_sums_to_one():
    t = np.arange(11.0)
    assert special.savgol(11, 3) @ (t**3 - 4 * t) == pytest.approx(t**3 - 4 * t, abs=1e-9)
    assert special.hrf().sum() == pytest.approx(1) and len(special.hrf(2.0)) == 16


# Expectations stated for the operators.


def test_window_counts_per_run(spark):
    clips = spark.createDataFrame([("a", 0, 0, 20), ("b", 0, 23, 22), ("c", 1, 40, 24), ("d", 1, 65, 40)], "video_id string, run int, onset int, dur int")
    runs = spark.createDataFrame([(0, 40), (1, 100)], "run int, n_tr int")
    found = windows.window_index(clips, runs, 5, 5, 5).groupBy("run").count().orderBy("run").collect()
    assert [r["count"] for r in found] == [6, 12]


@pytest.mark.parametrize(("durs", "width", "n"), [([10, 14, 8], 2, [5, 7, 4]), ([10, 12], 2, [5, 6])])
def test_full_windows(spark, durs, width, n):
    onsets = list(itertools.accumulate([0, *durs]))
    clips = spark.createDataFrame([(i, 0, o, d) for i, (o, d) in enumerate(zip(onsets, durs, strict=False))], "video_id int, run int, onset int, dur int")
    found = windows.window_index(clips, spark.createDataFrame([(0, 100)], "run int, n_tr int"), width, width)
    assert [r["count"] for r in found.groupBy("video_id").count().orderBy("video_id").collect()] == n


def test_fdr_and_max_stat(spark):
    q = inference.fdr(spark.createDataFrame([(i, p) for i, p in enumerate((0.001, 0.01, 0.2, 0.8))], "i int, p double"), "p").orderBy("i").collect()
    assert [r["q"] for r in q] == pytest.approx([0.004, 0.02, 0.8 / 3, 0.8])
    null = spark.createDataFrame([(p, u, v) for p, row in enumerate([(0.1, 0.2, 0.3), (0.2, 0.4, 0.1), (0.3, 0.1, 0.2)]) for u, v in enumerate(row)], "perm int, unit int, v double")
    seen = spark.createDataFrame([(0, 0.35), (1, 0.45), (2, 0.25)], "unit int, v double")
    found = inference.max_stat(null, seen, "v", 0.30).orderBy("unit").collect()
    assert [r["p"] for r in found] == pytest.approx([0.5, 0.25, 1.0]) and found[0]["critical"] == 0.4
    many = spark.range(1, 501).select(F.col("id").cast("int").alias("perm"), F.col("id").cast("double").alias("v"))
    for alpha, critical in ((0.01, 496), (0.005, 499)):
        assert inference.max_stat(many, seen, "v", alpha).first()["critical"] == critical


def test_elbow(spark):
    curve = list(zip([2, 3, 4, 5, 6, 8, 10], [0.40, 0.62, 0.76, 0.82, 0.85, 0.87, 0.88], strict=True))
    df = spark.createDataFrame([(d, v, 1 - v) for d, v in curve], "dim int, v double, w double")
    assert aggregates.elbow(df, "dim", "v").first()["dim"] == aggregates.elbow(df, "dim", "w", falling=True).first()["dim"] == 4


def test_r2_of_a_constant_is_null_and_reversal_is_negative(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("r", 1.0, 2.0), ("r", 2.0, 1.0)], "g string, y double, p double")
    found = {r["g"]: r["r2"] for r in aggregates.r2(df, "y", "p", "g").collect()}
    assert found["c"] is None and found["r"] < 0


def test_partition_adds_up(spark):
    r = {k: F.lit(v) for k, v in zip(("a", "v", "j", "av", "aj", "vj", "avj"), (0.1, 0.2, 0.15, 0.25, 0.22, 0.3, 0.34), strict=True)}
    row = spark.range(1).select(*[v.alias(k) for k, v in geometry.partition(r).items()]).first()
    assert sum(row) == pytest.approx(0.34)


def test_global_regression_centres_and_keeps_differences(spark):
    rows = [(u, 0, k, float(RNG.standard_normal() + 1000 * (u == "x"))) for u in "xyz" for k in range(20)]
    df = spark.createDataFrame(rows, "unit string, run int, k int, value double")
    out = signal.global_regression(df).toPandas().pivot(index="k", columns="unit", values="value")
    raw = df.toPandas().pivot(index="k", columns="unit", values="value")
    assert np.abs(out.mean(axis=1)).max() < 1e-9 and (out["x"] - out["y"]).to_numpy() == pytest.approx((raw["x"] - raw["y"]).to_numpy())


def test_high_pass_equals_polynomial_fits(spark):
    x = RNG.standard_normal(30)
    df = spark.createDataFrame([("u", 0, k, float(v)) for k, v in enumerate(x)], "unit string, run int, k int, value double")
    out = signal.high_pass(df, 9, 3).orderBy("k").toPandas()["value"].to_numpy()
    for i in range(30):
        a = min(max(i - 4, 0), 21)
        fit = np.polyfit(np.arange(9), x[a : a + 9], 3)
        assert out[i] == pytest.approx(x[i] - np.polyval(fit, i - a), abs=1e-8)


def test_partial_correlation_equals_residuals(spark):
    z = RNG.standard_normal((200, 2))
    x, y = z @ [1, 0.5] + RNG.standard_normal(200), z @ [0.3, -1] + RNG.standard_normal(200)
    residual = lambda v, d: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "a": z[:, 0], "b": z[:, 1]}))
    one, two = np.column_stack([np.ones(200), z[:, 0]]), np.column_stack([np.ones(200), z])
    got = df.agg(ranks.partial(F.corr("x", "y"), F.corr("x", "a"), F.corr("y", "a")).alias("p1"), geometry.partial_2("y", "x", "a", "b").alias("p2")).first()
    assert got["p1"] == pytest.approx(np.corrcoef(residual(x, one), residual(y, one))[0, 1])
    assert got["p2"] == pytest.approx(np.corrcoef(residual(x, two), residual(y, two))[0, 1])


def test_projection_residual_is_orthogonal(spark):
    a, v, t = RNG.standard_normal((3, 7))
    df = spark.createDataFrame([(a.tolist(), v.tolist(), t.tolist())], "a array<double>, v array<double>, t array<double>")
    r = np.array(df.select(V.projection_residual("t", "a", "v")).first()[0])
    assert abs(r @ a) < 1e-9 and abs(r @ v) < 1e-9


def test_crossnobis_equals_subject_pairs(spark):
    d = RNG.standard_normal((4, 3))
    df = spark.createDataFrame([(s, u, float(d[s, u])) for s in range(4) for u in range(3)], "subject int, unit int, delta double")
    want = sum(d[s] @ d[t] for s in range(4) for t in range(4) if s != t) / 12
    assert geometry.crossnobis(df).first()["d"] == pytest.approx(want)


def test_noise_ceiling_equals_leave_one_out(spark):
    d = RNG.standard_normal((5, 12)) + RNG.standard_normal(12)
    df = spark.createDataFrame([(s, p, float(d[s, p])) for s in range(5) for p in range(12)], "subject int, pair int, d double")
    got = geometry.noise_ceiling(df).first()
    assert got["upper"] == pytest.approx(np.mean([np.corrcoef(d[s], d.mean(axis=0))[0, 1] for s in range(5)]))
    assert got["lower"] == pytest.approx(np.mean([np.corrcoef(d[s], np.delete(d, s, 0).mean(axis=0))[0, 1] for s in range(5)]))


def test_semipartial_squared_is_unique_variance(spark):
    x = RNG.standard_normal((40, 3)) @ RNG.standard_normal((3, 3))
    y = x @ [1, 2, 3] + RNG.standard_normal(40)
    unit = lambda m: (m - m.mean(axis=0)) / np.linalg.norm(m - m.mean(axis=0), axis=0)
    g, c = unit(x).T @ unit(x), unit(x).T @ unit(y[:, None])[:, 0]
    full = c @ np.linalg.solve(g, c)
    less = c[:2] @ np.linalg.solve(g[:2, :2], c[:2])
    lit = lambda v: F.lit(float(v))
    sp = geometry.semipartial({n: lit(v) for n, v in zip("avj", c, strict=True)}, {("a", "v"): lit(g[0, 1]), ("a", "j"): lit(g[0, 2]), ("v", "j"): lit(g[1, 2])}, "j", ("a", "v"))
    row = spark.range(1).select(sp.alias("sp"), geometry.r2_three([lit(v) for v in c], lit(g[0, 1]), lit(g[0, 2]), lit(g[1, 2])).alias("r2")).first()
    assert row["sp"] ** 2 == pytest.approx(full - less) and row["r2"] == pytest.approx(full)


# Solvers.


def test_ridge_path_finds_the_band_that_matters():
    a, b = RNG.standard_normal((2, 60, 5))
    y = (a @ RNG.standard_normal((5, 2))) + 0.1 * RNG.standard_normal((60, 2))
    draws = np.array([[0.5, 0.5], [0.99, 0.01], [0.01, 0.99]])
    best, score = kernels.ridge_path([a, b], y, np.arange(60) % 4, draws, np.logspace(-2, 2, 5))
    assert (best[:, 0] == 1).all() and (score > 0.9).all()
    guess = kernels.ridge_predict([a], y, [a], np.array([1.0]), 1e-9)
    w = np.linalg.solve(a.T @ a + 1e-9 * np.eye(5), a.T @ (y - y.mean(axis=0)))
    assert guess == pytest.approx(a @ w + y.mean(axis=0), abs=1e-4)


def test_banded_ridge_does_not_see_held_out_rows(spark):
    x, j = RNG.standard_normal((2, 60, 4))
    y = j @ RNG.standard_normal(4)
    groups = np.arange(60) // 15
    targets = spark.createDataFrame([(0, y.tolist())], "target int, y array<double>")
    found = {r["subset"]: r["r2"] for r in models.banded_ridge({"a": x, "j": j}, groups, targets, 4, np.logspace(-2, 2, 5)).collect()}
    assert found["aj"] > 0.9 and found["j"] > 0.9 and found["a"] < 0.5


@pytest.mark.parametrize("method", ["ward", "hdbscan", "birch"])
def test_clusterings_find_blobs(method):
    x, truth = blobs(), np.repeat(np.arange(4), 30)
    found = {"ward": lambda: kernels.cut(kernels.ward(x), len(x), 4), "hdbscan": lambda: kernels.hdbscan(x, 10, 5), "birch": lambda: kernels.birch(x, 2.0)}[method]()
    for k in range(4):
        values, count = np.unique(found[truth == k], return_counts=True)
        assert count.max() >= 27 and values[count.argmax()] >= 0
    assert len({tuple(np.unique(found[truth == k])[-1:]) for k in range(4)}) == 4


def test_selective_clusters_bounds():
    x = blobs()
    kept = kernels.selective_clusters(kernels.ward(x), lambda m: float(len(m) == 30), len(x), 10, 40)
    assert [len(c) for c in kept] == [30] * 4


def test_hmm_prefers_two_states():
    x = np.concatenate([RNG.standard_normal((40, 2)) + s * 6 for s in (0, 1, 0, 1)])
    total, gamma = kernels.hmm(x, [80, 80], 2)
    labels = gamma.argmax(axis=1)
    assert total > kernels.hmm(x, [80, 80], 1)[0] and len(set(labels[:40])) == 1 and labels[0] != labels[45]
    assert gamma.sum(axis=1) == pytest.approx(np.ones(160))


def test_manifold_extension_uses_all_rows(spark):
    from geomlake.plans import catalog
    from geomlake.sources import tables

    sf = "/root/testdata/sf0.001"
    rows = tables.patterns(spark, sf).toPandas().sort_values("vec_id")
    found = catalog.queries()["manifold_extension"](spark, sf).toPandas().sort_values("vec_id")
    assert found["vec_id"].tolist() == rows["vec_id"].tolist() and len(rows) <= 2000
    x = np.stack(rows["x"]).astype(float)
    want = kernels.fast_ica(x, 2)
    got = found[["ica0", "ica1"]].to_numpy()
    close = np.abs(got.T @ want) / len(x)
    assert np.sort(close, axis=None) == pytest.approx([0, 0, 1, 1], abs=1e-3)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for names, plain in ((("mds0", "mds1"), kernels.classical_mds(d, 2)), (("iso0", "iso1"), kernels.classical_mds(kernels.geodesics(d, 6), 2))):
        assert np.abs(found[list(names)].to_numpy()) == pytest.approx(np.abs(plain), abs=1e-4)  # every row is a landmark


def test_mds_nmf_ica_and_geodesics():
    x = RNG.standard_normal((20, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    y = kernels.classical_mds(d, 2)
    assert np.sqrt(((y[:, None] - y) ** 2).sum(axis=2)) == pytest.approx(d, abs=1e-6)
    line = np.abs(np.subtract.outer(np.arange(10.0), np.arange(10.0)))
    assert kernels.geodesics(line, 2) == pytest.approx(line)
    m = RNG.random((12, 3)) @ RNG.random((3, 9))
    w, h = kernels.nmf(m, 3, 3000)
    assert np.abs(w @ h - m).max() < 0.05 and w.min() >= 0
    s = np.column_stack([np.sign(np.sin(np.arange(400) / 7)), np.modf(np.arange(400) / 23)[0] - 0.5])
    found = kernels.fast_ica(s @ [[1, 0.4], [0.3, 1]], 2)
    assert np.sort(np.abs(np.corrcoef(found.T, s.T)[:2, 2:]).max(axis=1)).min() > 0.95


def test_tfce_rewards_extent():
    line = [[j for j in (i - 1, i + 1) if 0 <= j < 12] for i in range(12)]
    v = np.array([0, 2, 2, 2, 2, 0, 0, 2, 0, 0, -1, 0], float)
    out = kernels.tfce(v, line)
    assert out[2] > out[7] > 0 > out[10] and out[0] == 0


# Graphs.


def line_graph(spark, n=9):
    return spark.createDataFrame([(a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "src int, dst int")


def test_components_borders_and_core(spark):
    mask = spark.createDataFrame([(v,) for v in (0, 1, 2, 4, 5, 7)], "vertex int")
    edges = line_graph(spark)
    labels = graph.components(mask, edges)
    assert {r["vertex"]: r["label"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 7: 7}
    assert {r["vertex"] for r in graph.kept_clusters(labels, 2).collect()} == {0, 1, 2, 4, 5}
    assert {r["vertex"] for r in graph.borders(mask, edges).collect()} == {2, 4, 5, 7}
    ring = spark.createDataFrame([(a, b) for x, y in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4)) for a, b in ((x, y), (y, x))], "src int, dst int")
    assert {r["vertex"] for r in graph.k_core(spark.range(5).select(F.col("id").cast("int").alias("vertex")), ring, 2).collect()} == {0, 1, 2}


def test_regions_and_saddles():
    line = [[j for j in (i - 1, i + 1) if 0 <= j < 7] for i in range(7)]
    v = np.array([1, 5, 3, 2, 4, 6, 1], float)
    assert graph.grown_regions(v, line, [[1], [5]], 0.5) == [[1, 2], [4, 5]]
    assert graph.merge_saddle(v, line, 1, 5) == 2


def test_geodesic_neighbours(spark):
    edges = line_graph(spark, 5).withColumn("g", F.lit(1)).withColumn("w", F.lit(1.0))
    found = graph.geodesic_knn(edges, "g", 2).where("src = 2").orderBy("rk").collect()
    assert [(r["dst"], r["dist"]) for r in found] == [(1, 1.0), (3, 1.0)]


# Sources and sinks.


def test_unknown_map_is_an_error(spark, tmp_path):
    store.write_maps(spark.createDataFrame([("a", 1, 2.0)], "map_name string, unit_id int, value double"), str(tmp_path / "m"))
    with pytest.raises(KeyError):
        store.read_maps(spark, str(tmp_path / "m"), "b")


def test_text_sources(spark, tmp_path):
    (tmp_path / "sheet.txt").write_text("note\r\nRun 1\r\n0,0,10\r\nclip,10,20.5\r\nbad,row\r\nRun 2\r\nx,1,y\r\n0,5,6\r\n")
    rows = [tuple(r)[1:] for r in timing.timing_sheet(spark, str(tmp_path / "sheet.txt")).collect()]
    assert rows == [(1, "0", True, 0.0, 10.0), (1, "clip", False, 10.0, 20.5), (2, "0", True, 5.0, 6.0)]
    (tmp_path / "ids.txt").write_text("# all\n\n sub1 x\nsub2\n")
    assert [r["id"] for r in timing.id_list(spark.read.text(str(tmp_path / "ids.txt")), first_token=True).collect()] == ["sub1", "sub2"]
    (tmp_path / "clips.csv").write_text("video_id,onset_sec,end_sec,duration_sec,run_id\na,0,10,10,1\n")
    assert timing.clip_timing(spark, str(tmp_path / "clips.csv")).first()["run_id"] == 1
    assert timing.prefix_matches(["A", "b"], "B") == "b"
    with pytest.raises(KeyError):
        timing.prefix_matches(["A"], "c")


def test_strict_classes(spark):
    good = spark.createDataFrame([(0, "a"), (1, "b")], "i int, c string")
    assert timing.strict_classes(good, 2, "i", "c", ("a", "b")).count() == 0
    bad = spark.createDataFrame([(0, "a"), (0, "z"), (3, "a")], "i int, c string")
    assert {(r[0], r[1]) for r in timing.strict_classes(bad, 2, "i", "c", ("a", "b")).collect()} == {("missing", "1"), ("index", "0"), ("index", "3"), ("class", "z"), ("empty", "b")}


def test_registry_rejects_what_it_does_not_know():
    from geomlake.sources.registry import Registry, Run

    r = Registry({"m": ("a", "v", "av"), "n": ("a",)}, (Run("m_less_n", "m.av", ("n.a",)),))
    assert r.joint("m") and not r.joint("n") and r.run("m_less_n").nuisance == ("n.a",)
    for call in (lambda: r.model("x"), lambda: r.run("x"), lambda: Registry({"m": ("a",)}, (Run("r", "x.a"),))):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        Registry({"m": ("a",)}, (Run("r", "m.a", ("m.a",)),))


def test_global_rank_spans_partitions(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1009).repartition(7)
    found = {r["id"]: r["rank"] for r in aggregates.global_rank(rows, F.desc("v"), F.col("id")).collect()}
    want = sorted(range(1000), key=lambda i: (-(i * 7919 % 1009), i))
    assert found == {i: k + 1 for k, i in enumerate(want)}
    assert aggregates.global_rank(rows.limit(0), F.col("v")).count() == 0


@pytest.mark.parametrize("method", ["ward", "hdbscan", "birch", "selective"])
def test_clusterings_hold_rows_not_pairs(method):
    import tracemalloc

    x = np.random.default_rng(1).standard_normal((1500, 16))
    merges = kernels.ward(x) if method == "selective" else None
    tracemalloc.start()
    {"ward": lambda: kernels.ward(x), "hdbscan": lambda: kernels.hdbscan(x, 5, 3), "birch": lambda: kernels.birch(x, 0.9), "selective": lambda: kernels.selective_clusters(merges, lambda m: 0.0, len(x), 4, 20)}[method]()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # a square of the rows has 18e6 bytes


def test_ward_of_distances_is_the_least_first():
    x = np.random.default_rng(2).standard_normal((40, 3))
    clusters, want = {i: [i] for i in range(40)}, []
    while len(clusters) > 1:
        cost = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        d, i, j = min((cost(clusters[i], clusters[j]), i, j) for i in clusters for j in clusters if i < j)
        clusters[40 + len(want)] = clusters.pop(i) + clusters.pop(j)
        want.append((i, j, math.sqrt(d), len(clusters[40 + len(want)])))
    assert kernels.ward(x) == pytest.approx(np.array(want))


def test_searchlight_cka_builds_no_matrix_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(v, v % 2, [float(c) for c in rng.standard_normal(6)]) for v in range(41)]
    rows = spark.createDataFrame(data, "vec_id long, label int, x array<double>")
    near, seed = {0: [0, 1, 2], 1: [3], 2: [2, 5]}, [3, 4, 5]
    got = {(r["label"], r["centre"]): r["value"] for r in geometry.searchlight_cka(rows, near, seed).collect()}
    for label in range(2):
        x = np.array([v for _, k, v in data if k == label])
        gram = lambda chosen: (c := x[:, chosen] - x[:, chosen].mean(axis=0)) @ c.T
        for centre, chosen in near.items():
            a, b = gram(chosen), gram(seed)
            want = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) if len(chosen) > 1 else 0.0
            assert got[label, centre] == pytest.approx(want)
