"""Queries without SQL against plain versions of the same on small tables."""

import collections
import itertools
import math

import duckdb
import numpy as np
import pytest

from geomlake.operators import kernels
from geomlake.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
NEAR = [[r * 8 + c for r, c in ((d // 8 - 1, d % 8), (d // 8 + 1, d % 8), (d // 8, d % 8 - 1), (d // 8, d % 8 + 1)) if 0 <= r < 8 and 0 <= c < 8] for d in range(64)]


@pytest.fixture(scope="module")
def patterns():
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def upper_t(t, df):
    """By summing the density."""
    x = np.linspace(t, t + 400, 400_001)
    y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def test_ttest_p_values(spark):
    for r in rows(spark, "ttest_p_values"):
        assert r["p"] == pytest.approx(upper_t(r["t"], r["df"]), rel=1e-3, abs=1e-6)


def test_fisher_p_values(spark):
    got = {r["source"]: r["p"] for r in rows(spark, "fisher_p_values")}
    table = duckdb.sql(f"SELECT source, count(*) FILTER (quality = 0 AND lang = 'en'), count(*) FILTER (quality = 0 AND lang <> 'en'), count(*) FILTER (quality = 1 AND lang = 'en'), count(*) FILTER (quality = 1 AND lang <> 'en') FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) GROUP BY source").fetchall()
    for source, a, b, c, d in table:
        chances = {k: math.comb(a + b, k) * math.comb(c + d, a + c - k) / math.comb(a + b + c + d, a + c) for k in range(max(0, a + c - c - d), min(a + b, a + c) + 1)}
        two, one = sum(p for p in chances.values() if p <= chances[a] * (1 + 1e-7)), sum(p for k, p in chances.items() if k >= a)
        assert min(abs(got[source] - two), abs(got[source] - one)) < 1e-6


def test_pca_evr_and_training_pca(spark, patterns):
    ids, labels, x = patterns
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert [r["share"] for r in sorted(rows(spark, "pca_evr"), key=lambda r: r["component"])] == pytest.approx((s / s.sum()).tolist(), abs=1e-6)
    train = x[labels != 3]
    axes = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)[2][:4]
    got = {r["vec_id"]: r for r in rows(spark, "training_pca")}
    for k in range(4):
        mine = np.array([got[i][f"c{k}"] for i in ids.tolist()])
        assert abs(np.corrcoef(mine, x @ axes[k])[0, 1]) > 1 - 1e-6
    assert all(got[i]["train"] == (label != 3) for i, label in zip(ids.tolist(), labels.tolist(), strict=True))


def test_interaction_residual(spark, patterns):
    ids, _, x = patterns
    u, j = x[:, :40], x[:, 40:]
    left = j - u @ np.linalg.solve(u.T @ u + 1e-6 * np.eye(40), u.T @ j)
    got = {r["vec_id"]: r["multimodality"] for r in rows(spark, "interaction_residual")}
    assert [got[i] for i in ids.tolist()] == pytest.approx(((left**2).sum(axis=1) / (j**2).sum(axis=1)).tolist(), abs=2e-6)


def plain_tfce(values):
    out = np.zeros(64)
    for sign in (1, -1):
        v = sign * values
        for height in np.arange(0.1, v.max() + 1e-12, 0.1):
            above = {d for d in range(64) if v[d] >= height}
            while above:
                cluster, edge = set(), {min(above)}
                while edge:
                    cluster |= edge
                    edge = {u for d in edge for u in NEAR[d] if u in above} - cluster
                for d in cluster:
                    out[d] += sign * len(cluster) ** 0.5 * height**2 * 0.1
                above -= cluster
    return out


def test_tfce_scores_and_inference(spark, patterns):
    ids, labels, x = patterns
    scores = {(r["label"], r["d"]): r["score"] for r in rows(spark, "tfce_scores")}
    found = {(r["label"], r["d"]): r for r in rows(spark, "tfce_inference")}
    t = lambda m: m.mean(axis=0) / (m.std(axis=0, ddof=1) / math.sqrt(len(m)))
    for label in np.unique(labels).tolist():
        own, subjects = x[labels == label], ids[labels == label].tolist()
        seen = plain_tfce(t(own))
        assert [scores[label, d] for d in range(64)] == pytest.approx(seen.tolist(), abs=1e-9)
        assert [found[label, d]["score"] for d in range(64)] == pytest.approx(seen.tolist(), abs=1e-6)
        if label < 2:
            tops = []
            for perm in range(200):
                signs = [1 - 2 * (((perm + 1) * 7919 + s * 104_729) % 1_000_003 // 8 % 2) for s in subjects]
                tops.append(plain_tfce(t(own * np.array(signs)[:, None])).max())
            for d in range(64):
                r = found[label, d]
                assert r["p"] == pytest.approx((sum(top >= seen[d] - 1e-6 for top in tops) + 1) / 201, abs=1e-2)
                assert r["threshold"] == pytest.approx(np.percentile(tops, 95), rel=1e-6) and r["significant"] == (r["score"] > r["threshold"])


def sheet(patterns):
    _, labels, x = patterns
    return {label: x[labels == label].mean(axis=0) for label in np.unique(labels).tolist()}, x.mean(axis=0)


def test_k_core(spark, patterns):
    kept = {d for d, v in enumerate(sheet(patterns)[1]) if v > 0}
    while weak := {d for d in kept if sum(u in kept for u in NEAR[d]) < 2}:
        kept -= weak
    assert {r["vertex"] for r in QUERIES["k_core"](spark, SF).collect()} == kept


def test_graph_knn(spark, patterns):
    got = {(r["label"], r["src"], r["rk"]): (r["dst"], r["dist"]) for r in rows(spark, "graph_knn")}
    fields = sheet(patterns)[0]
    for label, v in list(fields.items())[:3]:
        d = np.full((64, 64), np.inf)
        np.fill_diagonal(d, 0)
        for a in range(64):
            for b in NEAR[a]:
                d[a, b] = 1 + abs(v[a] - v[b])
        for m in range(64):
            d = np.minimum(d, d[:, m : m + 1] + d[m])
        for a in range(64):
            best = sorted((round(d[a, b], 6), b) for b in range(64) if b != a)[:6]
            mine = [got[label, a, k] for k in range(1, 7)]
            assert [m[1] for m in mine] == pytest.approx([w[0] for w in best], abs=1e-5)
    assert len(got) == 64 * 6 * len(fields)


def test_voxel_knn(spark, patterns):
    got = {}
    for r in QUERIES["voxel_knn"](spark, SF).collect():
        got.setdefault((r["label"], r["src"]), []).append((r["rk"], r["dst"], r["dist"]))
    at = {d: np.array([d // 16, d // 4 % 4, d % 4], float) for d in range(64)}
    n = 0
    for label, v in sheet(patterns)[0].items():
        mask = [d for d in range(64) if v[d] > 0]
        d = {(a, b): (0.0 if a == b else np.linalg.norm(at[a] - at[b]) if np.abs(at[a] - at[b]).max() <= 1 else np.inf) for a in mask for b in mask}
        for m in mask:
            d = {(a, b): min(w, d[a, m] + d[m, b]) for (a, b), w in d.items()}
        for a in mask:
            reached = sorted((round(d[a, b], 6), b) for b in mask if b != a and d[a, b] < np.inf)
            rest = sorted((round(((at[a] - at[b]) ** 2).sum(), 6), b) for b in mask if d[a, b] == np.inf)
            mine = sorted(got[label, a])
            assert [m[0] for m in mine] == list(range(1, min(8, len(mask) - 1) + 1))
            along = [m[2] for m in mine if m[2] is not None and not math.isnan(m[2])]
            assert along == pytest.approx([w for w, _ in reached[:8]], abs=1e-6)
            assert [m[1] for m in mine[len(along) :]] == [b for _, b in rest[: 8 - len(along)]]
            n += 1
    assert n == len(got)


def test_neighbours_are_filled_up_in_space(spark):
    from geomlake.operators import graph

    voxels = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 1, 0), (2, 5, 5, 5), (3, 9, 0, 0)], "vertex int, i int, j int, k int")
    edges = graph.voxel_edges(voxels).selectExpr("1 AS g", "src", "dst", "w")
    places = voxels.selectExpr("1 AS g", "vertex", "cast(array(i, j, k) AS array<double>) AS x")
    found = {(r["src"], r["rk"]): r["dst"] for r in graph.geodesic_knn(edges, "g", 2, places).collect()}
    assert found == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_region_growing(spark, patterns):
    got = {(r["label"], r["peak"]): r for r in rows(spark, "region_growing")}
    n = 0
    for label, v in sheet(patterns)[0].items():
        for peak in (d for d in range(64) if v[d] > 0 and all(v[d] >= v[u] for u in NEAR[d])):
            region, edge = set(), {peak}
            while edge:
                region |= edge
                edge = {u for d in edge for u in NEAR[d] if v[u] > v[peak] / 2} - region
            core = set(region)
            while weak := {d for d in core if sum(u in core for u in NEAR[d]) < 2}:
                core -= weak
            reached, edge = set(), {peak} & core
            while edge:
                reached |= edge
                edge = {u for d in edge for u in NEAR[d] if u in core} - reached
            r = got[label, peak]
            assert (r["size"], r["core"]) == (len(region), len(reached))
            n += 1
    assert n == len(got)


def test_smooth_basis_projection(spark, patterns):
    ids, _, x = patterns
    laplacian = np.diag([float(len(n)) for n in NEAR])
    for d, n in enumerate(NEAR):
        laplacian[d, n] -= 1
    got = {r["vec_id"]: r["smooth_power"] for r in rows(spark, "smooth_basis_projection")}
    # Eigenvalues of a square sheet come in pairs; the first five non-constant axes close a pair, the sixth may be any.
    values, axes = np.linalg.eigh(laplacian)
    low, high = ((x @ axes[:, 1 : k + 1]) ** 2 for k in (5, int(np.sum(values < values[6] + 1e-9)) - 1))
    for i, a, b in zip(ids.tolist(), low.sum(axis=1), high.sum(axis=1), strict=True):
        assert a - 1e-5 <= got[i] <= b + 1e-5


def test_ward_selectivity(spark, patterns):
    ids, labels, x = patterns
    got = {}
    for r in rows(spark, "ward_selectivity"):
        got.setdefault(r["label"], []).append((r["n"], r["first"], r["score"]))
    for label in np.unique(labels).tolist():
        own, names = x[labels == label], ids[labels == label]
        a, b = own[:, :32], own[:, 32:]

        def score(c):
            if not 4 <= len(c) <= 20:
                return -math.inf
            rest = [i for i in range(len(own)) if i not in c]
            if len(rest) < 2:
                return 0.0
            ts = [(b[c, u].mean() - b[rest, u].mean()) / math.sqrt(b[c, u].var(ddof=1) / len(c) + b[rest, u].var(ddof=1) / len(rest)) for u in range(32)]
            return float(np.median(ts))

        # Ward by brute force: join the two clusters whose joining adds the least squares.
        parts = [([i], None) for i in range(len(own))]
        cost = lambda p, q: len(p) * len(q) / (len(p) + len(q)) * ((a[p].mean(axis=0) - a[q].mean(axis=0)) ** 2).sum()
        while len(parts) > 1:
            i, j = min(itertools.combinations(range(len(parts)), 2), key=lambda ij: cost(parts[ij[0]][0], parts[ij[1]][0]))
            joined = (parts[i][0] + parts[j][0], (parts[i], parts[j]))
            parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [joined]

        def walk(node):
            members, halves = node
            if halves is None:
                return [members]
            own_score = score(members)
            falls = [score(h[0]) < own_score for h in halves]
            if all(falls):
                return [members]
            return [c for h, f in zip(halves, falls, strict=True) for c in ([h[0]] if f else walk(h))]

        want = sorted((len(c), int(names[c].min())) for c in walk(parts[0]))
        assert sorted(g[:2] for g in got[label]) == want and sum(w[0] for w in want) == len(own)


def test_connective_ridge_of_one_band(spark, patterns):
    ids, labels, x = patterns
    cells = sorted({(label, i % 12) for label, i in zip(labels.tolist(), ids.tolist(), strict=True)})
    f = np.array([x[(labels == label) & (ids % 12 == part)].mean(axis=0) for label, part in cells])
    groups, design = np.array([c[0] for c in cells]) % 5, f[:, :16]
    got = {r["target"]: r["r2"] for r in rows(spark, "connective_ridge") if r["subset"] == "a"}

    def guess(xs, y, new, penalty):
        z = (xs - xs.mean(axis=0)) / xs.std(axis=0)
        return (new - xs.mean(axis=0)) / xs.std(axis=0) @ np.linalg.solve(z.T @ z + penalty * np.eye(16), z.T @ (y - y.mean())) + y.mean()

    for target in (48, 55, 63):
        y, out = f[:, target], np.zeros(len(f))
        for held in np.unique(groups):
            train = groups != held
            # Inner folds centre and scale by the outer training rows, as the kernel is made once.
            z = (design[train] - design[train].mean(axis=0)) / design[train].std(axis=0)
            best = (-np.inf, 0)
            for p, penalty in enumerate(np.logspace(1, 20, 20)):
                total = 0.0
                for fold in np.unique(groups[train]):
                    a, b = groups[train] != fold, groups[train] == fold
                    ya, yb = y[train][a], y[train][b]
                    inner = z[b] @ np.linalg.solve(z[a].T @ z[a] + penalty * np.eye(16), z[a].T @ (ya - ya.mean())) + ya.mean()
                    total += 1 - ((yb - inner) ** 2).sum() / ((yb - yb.mean()) ** 2).sum()
                best = max(best, (total + (1e-9 if p == 0 else 0), -p))
            out[~train] = guess(design[train], y[train], design[~train], np.logspace(1, 20, 20)[-best[1]])
        assert got[target] == pytest.approx(1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)


def test_hmm_sweep(spark):
    got = {r["states"]: r for r in rows(spark, "hmm_states")}
    assert sorted(got) == [2, 3, 4] and all(-1 <= r["agreement"] <= 1 and r["held_out"] < 0 for r in got.values())
    assert got[4]["loglik"] > got[2]["loglik"]


def test_hmm_likelihood_by_every_path():
    rng = np.random.default_rng(2)
    x, lengths = rng.standard_normal((7, 2)), [4, 3]
    model = kernels.hmm_fit(x, lengths, 2, steps=3)
    density = np.exp(-0.5 * ((x[:, None] - model.means) ** 2 / model.var + np.log(2 * np.pi * model.var)).sum(axis=2))
    total, at, gamma = 0.0, 0, np.zeros((7, 2))
    for n in lengths:
        chances = {p: model.first[p[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(density[at + t, s] for t, s in enumerate(p)) for p in itertools.product((0, 1), repeat=n)}
        whole = sum(chances.values())
        for p, c in chances.items():
            gamma[np.arange(at, at + n), list(p)] += c / whole
        total, at = total + math.log(whole), at + n
    found = model.passed(x, lengths)
    assert found[0] == pytest.approx(total) and found[1] == pytest.approx(gamma)


def test_adjusted_rand():
    a = np.array([0, 0, 1, 1, 2, 2])
    assert kernels.adjusted_rand(a, np.array([5, 5, 3, 3, 9, 9])) == 1
    assert kernels.adjusted_rand(a, np.array([0, 0, 1, 2, 2, 2])) == pytest.approx((2 - 3 * 4 / 15) / (3.5 - 12 / 15))


def test_kmeans_finds_the_best_of_many_starts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((20, 2)) + c for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    labels, cost = kernels.kmeans(x, 4)
    assert all(len(set(labels[20 * k : 20 * k + 20].tolist())) == 1 for k in range(4)) and len(set(labels.tolist())) == 4
    assert cost == pytest.approx(sum(((x[20 * k : 20 * k + 20] - x[20 * k : 20 * k + 20].mean(axis=0)) ** 2).sum() for k in range(4)))


def test_embedding_quality_by_loops():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 6))
    y = x[:, :2]
    got = kernels.embedding_quality(x, y, 4)
    order = lambda m, i: sorted((j for j in range(30) if j != i), key=lambda j: (np.linalg.norm(m[i] - m[j]), j))

    def kept(near, far):
        loss = sum(max(0, order(far, i).index(j) + 1 - 4) for i in range(30) for j in order(near, i)[:4])
        return 1 - 2 / (30 * 4 * (60 - 13)) * loss

    assert (got["trust"], got["continuity"]) == pytest.approx((kept(y, x), kept(x, y)), abs=1e-9)
    assert got["score"] == pytest.approx(0.4 * got["trust"] + 0.4 * got["continuity"] + 0.1 * (got["rho"] + 1))
    same = kernels.embedding_quality(x, x @ np.linalg.qr(rng.standard_normal((6, 6)))[0], 4)
    assert same["score"] == pytest.approx(1)


@pytest.mark.parametrize("method", ["tsne", "umap"])
def test_neighbour_embeddings_keep_neighbours(method):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((30, 8)) + 12 * rng.standard_normal(8) for _ in range(4)])
    y, value = kernels.reduced(x, method, 2)
    near = ((y[:, None] - y) ** 2).sum(axis=2) + np.eye(120) * 1e9
    assert (near.argsort(axis=1)[:, :5] // 30 == np.arange(120)[:, None] // 30).mean() > 0.98
    assert kernels.embedding_quality(x, y, 5)["trust"] > 0.9 and (value < 1 if method == "tsne" else value > 0.7)


def test_tsne_gradient_and_perplexity():
    """The divergence can't be lowered much by small moves, and grows when the places are mixed."""
    x = np.random.default_rng(6).standard_normal((60, 5))
    y, value = kernels.tsne(x, 2, perplexity=10)
    assert y.shape == (60, 2) and 0 < value < 1.2
    assert kernels.tsne(x, 2, perplexity=10, steps=5)[1] > value


def test_rows_of_the_sample_keep_their_places(spark, patterns):
    ids, _, x = patterns
    got = {r["vec_id"]: (r["tsne0"], r["tsne1"]) for r in rows(spark, "neighbour_embeddings")}
    assert set(got) == set(ids.tolist())
    order = sorted(range(len(ids)), key=lambda i: ((int(ids[i]) * 7919 + 3) % 1_000_003, ids[i]))[:400]
    y = kernels.reduced(x[order], "tsne", 2)[0]
    assert np.array([got[int(ids[i])] for i in order]) == pytest.approx(y, abs=1e-3)


def test_grid_and_dimensions(spark):
    grid = rows(spark, "model_grid")
    assert len(grid) == 36 and all(0 <= r["trust"] <= 1 and -1 <= r["rho"] <= 1 for r in grid)
    assert {(r["method"], r["k"], r["clusterer"]) for r in grid} == set(itertools.product(("pca", "mds", "isomap", "fastica", "tsne", "umap"), (2, 3), ("kmeans", "hdbscan", "birch")))
    assert all(r["clusters"] == 4 for r in grid if r["clusterer"] == "kmeans")
    assert {r["method"] for r in rows(spark, "dimension_choice")} == {"pca", "mds", "isomap", "fastica", "tsne", "umap"}


def test_resamples_are_draws_with_replacement(spark):
    from geomlake.operators import inference

    items = spark.createDataFrame([(i * 3, 1.0) for i in range(50)], "subject int, value double")
    got = inference.resamples(items, "subject", 200).toPandas()
    assert (got.groupby("boot")["w_subject"].sum() == 50).all() and got["boot"].nunique() == 200
    counts = np.zeros((200, 50))
    counts[got["boot"], got["subject"] // 3] = got["w_subject"]
    assert counts.mean() == 1 and 0.8 < counts.var(axis=0).mean() < 1.2


def test_loops_that_do_not_settle_raise(spark):
    from geomlake.operators import graph

    edges = spark.createDataFrame([(i, j) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "src int, dst int")
    vertices = spark.range(6).selectExpr("cast(id as int) AS vertex")
    with pytest.raises(RuntimeError):
        graph.components(vertices, edges, rounds=1)
    with pytest.raises(RuntimeError):
        graph.k_core(vertices, edges, 2, rounds=1)


def test_resamples_of_more_items_than_an_int_times_the_hash_factor_holds(spark):
    from geomlake.operators import inference

    n = 25_000
    got = inference.resamples(spark.range(n).withColumnRenamed("id", "subject"), "subject", 2).toPandas()
    for boot in range(2):
        x = [((boot + 1) * 7919 + j * 104_729 + 17) % 1_000_003 for j in range(n)]
        want = collections.Counter(((v * v % 1_000_003) * v % 1_000_003) % n for v in x)
        assert dict(got[got["boot"] == boot][["subject", "w_subject"]].itertuples(index=False)) == want
