"""Queries of models and graphs. Solvers without an SQL form are held against brute force in tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from geomlake.functions import vectors as V
from geomlake.functions.vectors import r6
from geomlake.operators import aggregates, blocked, ranking
from geomlake.operators import graph as N
from geomlake.operators import inference as H
from geomlake.operators import kernels as K
from geomlake.operators import models as M
from geomlake.operators import pairs as P
from geomlake.plans import q_pairs as Q
from geomlake.plans.registry import query
from geomlake.sources import store
from geomlake.sources import tables as T


@query("M01", f"WITH {T.SQL_CLIPS} SELECT f.run AS fold, count(*) FILTER (clips.run = f.run) AS n_test, count(*) FILTER (clips.run <> f.run) AS n_train FROM clips, (SELECT DISTINCT run FROM clips) f GROUP BY f.run")
def fold_sizes(spark, sf_dir):
    rows = M.folds(T.clips(spark, sf_dir), "run")
    return rows.groupBy("fold").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query("M07 E09", f"WITH {T.SQL_S}, w AS (SELECT run, k, avg(value) AS x FROM s WHERE unit IN ('view', 'click') GROUP BY ALL) SELECT unit, run, round(coalesce(regr_r2(value, x), 0), 6) AS r2 FROM s JOIN w USING (run, k) GROUP BY ALL")
def null_r2(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    w = s.where(F.col("unit").isin("view", "click")).groupBy("run", "k").agg(F.avg("value").alias("x"))
    return s.join(w, ["run", "k"]).groupBy("unit", "run").agg(F.round(F.coalesce(F.regr_r2("value", "x"), F.lit(0.0)), 6).alias("r2"))


@query("M18", f"WITH {T.SQL_S}, g AS (SELECT run, k, avg(value) AS g FROM s GROUP BY ALL), r AS (SELECT unit, run, k, value - avg(value) OVER w - regr_slope(value, g) OVER w * (g - avg(g) OVER w) AS r FROM s JOIN g USING (run, k) WINDOW w AS (PARTITION BY unit)) SELECT unit, run, k, round(r / stddev_pop(r) OVER (PARTITION BY unit), 6) + 0.0 AS z FROM r")
def global_series_regression(spark, sf_dir):
    s = T.signal(spark, sf_dir).withColumn("g", F.avg("value").over(Window.partitionBy("run", "k")))
    w = Window.partitionBy("unit")
    r = s.withColumn("r", F.col("value") - F.avg("value").over(w) - F.regr_slope("value", "g").over(w) * (F.col("g") - F.avg("g").over(w)))
    return r.select("unit", "run", "k", r6(F.col("r") / F.stddev_pop("r").over(w)).alias("z"))


_XY = "SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem"


@query("M08", f"WITH t AS ({_XY}), m AS (SELECT count(*) AS n, covar_pop(a, a) * count(*) + 100 AS aa, covar_pop(b, b) * count(*) + 100 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS \"by\" FROM t) SELECT round((bb * ay - ab * \"by\") / (aa * bb - ab * ab), 4) AS wa, round((aa * \"by\" - ab * ay) / (aa * bb - ab * ab), 4) AS wb FROM m")
def ridge_plain(spark, sf_dir):
    rows = T.read(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount").alias("x"), F.col("l_extendedprice").alias("y"))
    w = M.ridge(rows, "x", "y", 100.0)
    return spark.createDataFrame([(round(float(w[0]), 4), round(float(w[1]), 4))], "wa double, wb double")


@query("M03 M09")
def pca_evr(spark, sf_dir):
    evr = M.explained_variance(T.patterns(spark, sf_dir), "x")
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(evr)], "component int, share double")


@query("M03 M01")
def training_pca(spark, sf_dir):
    rows = T.patterns(spark, sf_dir).withColumn("train", F.col("label") != 3)
    axes = M.components(rows, "x", 4, "train")
    scores = [V.dot("x", F.array(*map(F.lit, map(float, a)))).alias(f"c{k}") for k, a in enumerate(axes.T)]
    return rows.select("vec_id", "train", *scores)


@query("M02 M01 E09 E11")
def banded_ridge_partition(spark, sf_dir):
    """Targets: the last 16 features; bands: features 0-15, 16-31, 32-47; windows: labels' means; groups: halves of ten."""
    return M.banded_ridge(*_windows(spark, sf_dir))


@query("M04 M02")
def connective_ridge(spark, sf_dir):
    """As above with two regions as bands, standardized, and penalties of 1e1 to 1e20."""
    design, groups, targets = _windows(spark, sf_dir)
    return M.banded_ridge({"a": design["a"], "v": design["v"]}, groups, targets, penalties=np.logspace(1, 20, 20), scale=True)


def _windows(spark, sf_dir):
    rows = T.patterns(spark, sf_dir).groupBy("label", (F.col("vec_id") % 12).alias("part")).agg(*[F.avg(F.col("x")[i]).alias(f"f{i}") for i in range(64)])
    table = rows.orderBy("label", "part").toPandas()  # at most 10 labels by 12 parts
    x = table[[f"f{i}" for i in range(64)]].to_numpy()
    design = {"a": x[:, :16], "j": x[:, 32:48], "v": x[:, 16:32]}
    targets = spark.createDataFrame([(i, [float(v) for v in x[:, i]]) for i in range(48, 64)], "target int, y array<double>")
    return design, table["label"].to_numpy() % 5, targets.repartition(4)


@query("G16")
def interaction_residual(spark, sf_dir):
    x = F.col("x")
    rows = T.patterns(spark, sf_dir).select("vec_id", F.slice(x, 41, 24).alias("j"), F.slice(x, 1, 40).alias("u"))
    b = M.linear_residual(rows, "j", "u")
    guess = F.array(*[V.dot("u", F.array(*map(F.lit, map(float, column)))) for column in b.T])
    left = rows.select("vec_id", V.minus("j", guess).alias("r"), "j")
    return left.select("vec_id", F.round(V.dot("r", "r") / F.greatest(V.dot("j", "j"), F.lit(1e-12)), 6).alias("multimodality"))


@query("M12 M15")
def kmeans_sweep(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = T.patterns(spark, sf_dir).select("vec_id", array_to_vector(V.unit("x")).alias("features"))
    # The best of several starts: k-means|| has its own many candidates in each.
    costs = [(k, min(float(KMeans(k=k, seed=seed, maxIter=20).fit(rows).summary.trainingCost) for seed in (7, 8, 9))) for k in (2, 4, 6, 8)]
    return spark.createDataFrame(costs, "k int, cost double")


@query("M11 M12 M15 M16 E14")
def cluster_grid(spark, sf_dir):
    def sweep(ids, x):
        merges, n = K.ward(x), len(x)
        w, _ = K.nmf(np.concatenate([np.maximum(x, 0), np.maximum(-x, 0)], axis=1), 3)
        found = {"ward": K.cut(merges, n, min(4, n)), "hdbscan": K.hdbscan(x, 5, 3), "birch": K.birch(x, 0.9), "nmf": w.argmax(axis=1)}
        return pd.DataFrame([(m, int(v.max() + 1), int((v < 0).sum()), n) for m, v in found.items()], columns=["method", "clusters", "noise", "n"])

    return M.per_group(T.patterns(spark, sf_dir), "label", sweep, "method string, clusters int, noise int, n int")


@query("M16 H14")
def ward_selectivity(spark, sf_dir):
    """Stimuli: the first 32 features; units that clusters are scored on: the others."""

    def select(ids, x):
        kept = K.selective_clusters(K.ward(x[:, :32]), lambda members: K.median_welch_t(x[:, 32:], members), len(x), 4, 20)
        return pd.DataFrame([(i, len(c), int(ids[c].min()), round(K.median_welch_t(x[:, 32:], c), 6)) for i, c in enumerate(kept)], columns=["cluster", "n", "first", "score"])

    return M.per_group(T.patterns(spark, sf_dir), "label", select, "cluster int, n int, first long, score double")


#: TRs of a signal that one task holds at most.
SIGNAL = 2_000_000


@query("M10")
def hmm_states(spark, sf_dir):
    """By number of states: the best of five starts, its BIC and agreement with the second best, and the mean likelihood of held-out runs."""
    s = T.signal(spark, sf_dir).groupBy("run", "k").pivot("unit", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))
    if s.count() > SIGNAL:
        raise ValueError(f"a signal of more than {SIGNAL} TRs")
    table = s.orderBy("run", "k").toPandas()
    x = table[["click", "error", "purchase", "signup", "view"]].to_numpy(float)
    x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    shared = spark.sparkContext.broadcast((x, table["run"].to_numpy()))
    runs = sorted(set(table["run"].tolist()))
    tasks = [(k, start, -1) for k in (2, 3, 4) for start in range(5)] + [(k, 0, run) for k in (2, 3, 4) for run in runs]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, run = shared.value
        k, start, held = (int(v) for v in part.iloc[0])
        lengths = lambda rows: pd.Series(run[rows]).value_counts(sort=False).tolist()
        test = run == held
        model = K.hmm_fit(x[~test], lengths(~test), k, steps=15, start=start)
        if held >= 0:
            return pd.DataFrame([(k, start, held, model.passed(x[test], lengths(test))[0], [])], columns=["states", "start", "held", "loglik", "path"])
        total, gamma = model.passed(x, lengths(~test))[:2]
        return pd.DataFrame([(k, start, held, total, gamma.argmax(axis=1).tolist())], columns=["states", "start", "held", "loglik", "path"])

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        fits = part[part["held"] < 0].sort_values(["loglik", "start"], ascending=[False, True])
        k, best, n, d = int(part["states"].iloc[0]), fits.iloc[0], *shared.value[0].shape
        agreement = K.adjusted_rand(np.array(best["path"]), np.array(fits.iloc[1]["path"]))
        free = k * k + 2 * k * d - 1
        return pd.DataFrame([(k, int(best["start"]), float(best["loglik"]), float(free * np.log(n) - 2 * best["loglik"]), agreement, float(part.loc[part["held"] >= 0, "loglik"].mean()))])

    schema = "states int, start int, held int, loglik double, path array<int>"
    fits = spark.createDataFrame(tasks, "states int, start int, held int").groupBy("states", "start", "held").applyInPandas(fit, schema)
    return fits.groupBy("states").applyInPandas(chosen, "states int, start int, loglik double, bic double, agreement double, held_out double")


#: Of the scaling methods, as in the reference; ICA is fitted on all rows.
LANDMARKS = 2000


@query("M13 R10")
def manifold_extension(spark, sf_dir):
    rows = T.patterns(spark, sf_dir)
    marks = rows.orderBy((F.col("vec_id") * 7919 + 3) % 1_000_003, "vec_id").limit(LANDMARKS).toPandas()
    x = np.stack(marks["x"]).astype(float)
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    places = np.concatenate([K.classical_mds(d, 2), K.classical_mds(K.geodesics(d, 6), 2)], axis=1)
    near = M.landmark_extension(x, places, rows).select("vec_id", *[F.round(F.col("y")[k], 6).alias(n) for k, n in enumerate(("mds0", "mds1", "iso0", "iso1"))])
    mean, axes = M.ica(rows, "x", 2)
    sources = [F.round(V.dot("x", F.array(*map(F.lit, map(float, a)))) - float(mean @ a), 6).alias(f"ica{k}") for k, a in enumerate(axes.T)]
    return near.join(rows.select("vec_id", *sources), "vec_id")


@query("M14", f"WITH {T.SQL_V}, p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_distance(a.x, b.x) ** 2 AS h, list_distance(a.x[1:3], b.x[1:3]) ** 2 AS l FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT label, i, row_number() OVER (PARTITION BY i ORDER BY h, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY l, j) AS rl, count(*) OVER (PARTITION BY i) + 1 AS n FROM p), tc AS (SELECT label, 1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(CASE WHEN rl <= 5 AND rh > 5 THEN rh - 5 ELSE 0 END) AS trust, 1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(CASE WHEN rh <= 5 AND rl > 5 THEN rl - 5 ELSE 0 END) AS continuity FROM r GROUP BY label), k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY h) + (count(*) OVER (PARTITION BY label, h) - 1) / 2.0 AS rh, rank() OVER (PARTITION BY label ORDER BY l) + (count(*) OVER (PARTITION BY label, l) - 1) / 2.0 AS rl FROM p WHERE i > j), c AS (SELECT label, corr(rh, rl) AS rho FROM k GROUP BY label) SELECT label, round(trust, 6) AS trust, round(continuity, 6) AS continuity, round(rho, 6) + 0.0 AS rho, round(0.4 * trust + 0.4 * continuity + 0.2 * (rho + 1) / 2, 6) AS score FROM tc JOIN c USING (label)")
def embedding_quality(spark, sf_dir):
    rows, measures, n = T.patterns(spark, sf_dir), {"h": blocked.squared, "l": blocked.band(blocked.squared, 1, 3)}, F.col("n")
    share = lambda c: (1 - F.lit(2.0) / (n * 5 * (2 * n - 16)) * F.col(c)).alias(c)
    found = ranking.kept_neighbours(rows, *measures.values(), 5).select("label", share("trust"), share("continuity"))
    found = found.join(ranking.correlations(rows, measures, [("h", "l")]).select("label", F.col("h_l").alias("rho")), "label")
    score = 0.4 * F.col("trust") + 0.4 * F.col("continuity") + 0.2 * (F.col("rho") + 1) / 2
    return found.select("label", F.round("trust", 6).alias("trust"), F.round("continuity", 6).alias("continuity"), r6("rho").alias("rho"), F.round(score, 6).alias("score"))


#: Rows of the fixed sample that reducers and clusterers are compared on.
SELECTION, REDUCERS = 400, ("pca", "mds", "isomap", "fastica", "tsne", "umap")


def _swept(spark, sf_dir, configs, schema, kernel):
    """kernel(x, *config) of every config, a row each, on the sample: a bounded matrix, broadcast."""
    marks = T.patterns(spark, sf_dir).orderBy((F.col("vec_id") * 7919 + 3) % 1_000_003, "vec_id").limit(SELECTION).toPandas()
    shared = spark.sparkContext.broadcast(np.stack(marks["x"]).astype(float))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        config = [v.item() if hasattr(v, "item") else v for v in part.iloc[0]]
        return pd.DataFrame([[*config, *kernel(shared.value, *config)]])

    names = [c.split(" ")[0] for c in configs[1].split(", ")]
    return spark.createDataFrame(*configs).groupBy(*names).applyInPandas(run, f"{configs[1]}, {schema}")


@query("M13 R10")
def neighbour_embeddings(spark, sf_dir):
    """t-SNE and UMAP of the sample, and every row's place among its nearest of the sample."""
    rows = T.patterns(spark, sf_dir)
    marks = rows.orderBy((F.col("vec_id") * 7919 + 3) % 1_000_003, "vec_id").limit(SELECTION).toPandas()
    x = np.stack(marks["x"]).astype(float)
    places = np.concatenate([K.reduced(x, m, 2)[0] for m in ("tsne", "umap")], axis=1)
    return M.landmark_extension(x, places, rows).select("vec_id", *[F.round(F.col("y")[k], 6).alias(n) for k, n in enumerate(("tsne0", "tsne1", "umap0", "umap1"))])


@query("M14 M15 R05")
def dimension_choice(spark, sf_dir):
    """For each reducer the dimension at the elbow of its own criterion."""
    configs = [(m, k) for m in REDUCERS for k in range(1, 7)]
    found = _swept(spark, sf_dir, (configs, "method string, k int"), "value double", lambda x, method, k: [K.reduced(x, method, k)[1]])
    found = found.withColumn("rising", F.when(F.col("method").isin("pca", "umap"), F.col("value")).otherwise(-F.col("value")))
    return aggregates.elbow(found, "k", "rising", "method")


@query("M12 M14 M15 E14")
def model_grid(spark, sf_dir):
    """Reducers by clusterers: quality of the embedding, and clusters of its standardized coordinates."""

    def fit(x, method, k, clusterer):
        y, value = K.reduced(x, method, k)
        q = K.embedding_quality(x, y, 5)
        z = (y - y.mean(axis=0)) / np.maximum(y.std(axis=0), 1e-12)
        labels = {"kmeans": lambda: K.kmeans(z, 4)[0], "hdbscan": lambda: K.hdbscan(z, 8, 4), "birch": lambda: K.birch(z, 0.5)}[clusterer]()
        return [value, q["trust"], q["continuity"], q["rho"], q["score"], int(labels.max() + 1), int((labels < 0).sum())]

    configs = [(m, k, c) for m in REDUCERS for k in (2, 3) for c in ("kmeans", "hdbscan", "birch")]
    return _swept(spark, sf_dir, (configs, "method string, k int, clusterer string"), "value double, trust double, continuity double, rho double, score double, clusters int, noise int", fit)


def _field(spark, sf_dir):
    """label, d and the mean feature at each place of the sheet."""
    return T.long_patterns(spark, sf_dir).groupBy("label", "d").agg(F.avg("x").alias("v"))


@query("")
def tfce_scores(spark, sf_dir):
    near = [[r * 8 + c for r, c in ((d // 8 - 1, d % 8), (d // 8 + 1, d % 8), (d // 8, d % 8 - 1), (d // 8, d % 8 + 1)) if 0 <= r < 8 and 0 <= c < 8] for d in range(64)]
    stats = T.long_patterns(spark, sf_dir).groupBy("label", "d").agg((F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("*")))).alias("t"))

    def enhance(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("d")
        return pd.DataFrame({"label": part["label"], "d": part["d"], "score": K.tfce(part["t"].to_numpy(float), near)})

    return stats.groupBy("label").applyInPandas(enhance, "label int, d int, score double")


@query("H11 H08 H04")
def tfce_inference(spark, sf_dir):
    """Subjects: a label's patterns; maps: means over them on the sheet. Sign flips give the null of the largest score."""
    near = [[r * 8 + c for r, c in ((d // 8 - 1, d % 8), (d // 8 + 1, d % 8), (d // 8, d % 8 - 1), (d // 8, d % 8 + 1)) if 0 <= r < 8 and 0 <= c < 8] for d in range(64)]
    sums, n = H.signed_sums(T.patterns(spark, sf_dir), "label", "vec_id", "x", 200), F.col("n")
    var = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    t = sums.select("label", "perm", "at", F.when(var > 0, F.col("s") / n / F.sqrt(var / n)).otherwise(0.0).alias("t"))

    def enhance(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        return pd.DataFrame({"label": part["label"], "perm": part["perm"], "d": part["at"], "score": K.tfce(part["t"].to_numpy(float), near)})

    scores = store.stored(t.groupBy("label", "perm").applyInPandas(enhance, "label int, perm int, d int, score double"), "tfce")
    null, seen = scores.where("perm >= 0"), scores.where("perm = -1").select("label", "d", "score")
    limits = null.groupBy("label", "perm").agg(F.max("score").alias("top")).groupBy("label").agg(F.percentile("top", F.lit(0.95)).alias("threshold"))
    held = H.max_stat(null, seen, "score", 0.05, "label").drop("critical").join(limits, "label")
    return held.select("label", "d", "score", "p", "threshold", (F.col("score") > F.col("threshold")).alias("significant"))


SQL_SHEET = f"{Q.SQL_GRID}, {T.SQL_E}, f AS (SELECT d, avg(x) AS v FROM e GROUP BY d), ed AS (SELECT a.d AS src, b.d AS dst FROM g a JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), mask AS (SELECT d FROM f WHERE v > 0)"


def _sheet(spark, sf_dir):
    """Edges of the 8 by 8 sheet and the places with a positive mean."""
    g = Q.grid(spark)
    steps = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    edges = g.select(F.col("d").alias("src"), steps.alias("n")).join(g.select(F.struct("row", "col").alias("n"), F.col("d").alias("dst")), "n").select("src", "dst")
    mask = T.long_patterns(spark, sf_dir).groupBy("d").agg(F.avg("x").alias("v")).where("v > 0").select(F.col("d").alias("vertex"))
    return edges, mask


@query("N01", f"WITH RECURSIVE {SQL_SHEET}, walk AS (SELECT d AS vertex, d AS seen FROM mask UNION SELECT vertex, dst FROM walk JOIN ed ON seen = src JOIN mask ON dst = mask.d) SELECT vertex, min(seen) AS label FROM walk GROUP BY vertex")
def mesh_components(spark, sf_dir):
    edges, mask = _sheet(spark, sf_dir)
    return N.components(mask, edges)


@query("N01 N02", f"WITH RECURSIVE {SQL_SHEET}, walk AS (SELECT d AS vertex, d AS seen FROM mask UNION SELECT vertex, dst FROM walk JOIN ed ON seen = src JOIN mask ON dst = mask.d), l AS (SELECT vertex, min(seen) AS label FROM walk GROUP BY vertex), k AS (SELECT vertex FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 3)) SELECT vertex FROM k WHERE EXISTS (SELECT 1 FROM ed WHERE src = vertex AND dst NOT IN (SELECT d FROM mask))")
def cluster_borders(spark, sf_dir):
    edges, mask = _sheet(spark, sf_dir)
    kept = N.kept_clusters(N.components(mask, edges), 3).select("vertex")
    return N.borders(mask, edges).join(kept, "vertex", "left_semi")


@query("N03")
def k_core(spark, sf_dir):
    edges, mask = _sheet(spark, sf_dir)
    return N.k_core(mask, edges, 2)


@query("J14", f"WITH {Q.SQL_GRID}, t AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.row = a.row + 1 AND c.col = a.col), p AS (SELECT a AS src, b AS dst FROM t UNION SELECT b, a FROM t UNION SELECT b, c FROM t UNION SELECT c, b FROM t UNION SELECT c, a FROM t UNION SELECT a, c FROM t) SELECT src, dst FROM p WHERE src % 9 <> 4 AND dst % 9 <> 4")
def mesh_edges(spark, sf_dir):
    g = Q.grid(spark)
    right = g.select(F.col("d").alias("b"), "row", (F.col("col") - 1).alias("col"))
    below = g.select(F.col("d").alias("c"), (F.col("row") - 1).alias("row"), "col")
    faces = g.withColumnRenamed("d", "a").join(right, ["row", "col"]).join(below, ["row", "col"]).select("a", "b", "c")
    return N.edges_of_faces(faces, g.where("d % 9 <> 4").select(F.col("d").alias("vertex")))


@query("J07")
def graph_knn(spark, sf_dir):
    edges, _ = _sheet(spark, sf_dir)
    f = _field(spark, sf_dir)
    ends = edges.join(f.select("label", F.col("d").alias("src"), F.col("v").alias("vs")), "src").join(f.select("label", F.col("d").alias("dst"), F.col("v").alias("vd")), ["label", "dst"])
    return N.geodesic_knn(ends.select("label", "src", "dst", (1 + F.abs(F.col("vs") - F.col("vd"))).alias("w")), "label", 6)


@query("J07 J14")
def voxel_knn(spark, sf_dir):
    """The features as a cube of 4 by 4 by 4 voxels; a label's mask: those with a positive mean."""
    d = F.col("d")
    voxels = spark.range(64).select(F.col("id").cast("int").alias("d")).select(d.alias("vertex"), F.floor(d / 16).cast("int").alias("i"), (F.floor(d / 4) % 4).cast("int").alias("j"), (d % 4).cast("int").alias("k"))
    mask = _field(spark, sf_dir).where("v > 0").select("label", d.alias("vertex"))
    places = mask.join(voxels, "vertex").select("label", "vertex", F.array("i", "j", "k").cast("array<double>").alias("x"))
    ends = N.voxel_edges(voxels).join(mask.withColumnRenamed("vertex", "src"), "src").join(mask.withColumnRenamed("vertex", "dst"), ["label", "dst"])
    return N.geodesic_knn(ends.select("label", "src", "dst", "w"), "label", 8, places)


@query("N04")
def region_growing(spark, sf_dir):
    near = [[r * 8 + c for r, c in ((d // 8 - 1, d % 8), (d // 8 + 1, d % 8), (d // 8, d % 8 - 1), (d // 8, d % 8 + 1)) if 0 <= r < 8 and 0 <= c < 8] for d in range(64)]

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values("d")["v"].to_numpy(float)
        peaks = [d for d in range(64) if v[d] > 0 and all(v[d] >= v[u] for u in near[d])]
        regions, cores = (N.grown_regions(v, near, [[p] for p in peaks], 0.5, degree) for degree in (0, 2))
        shared = [len({*r} & {*regions[0]}) for r in regions]
        saddle = [N.merge_saddle(v, near, peaks[0], p) if p != peaks[0] else float(v[p]) for p in peaks]
        return pd.DataFrame({"label": part["label"].iloc[0], "peak": peaks, "size": [len(r) for r in regions], "core": [len(r) for r in cores], "shared": shared, "saddle": saddle})

    return _field(spark, sf_dir).groupBy("label").applyInPandas(grow, "label int, peak int, size int, core int, shared int, saddle double")


@query("M06 M05")
def smooth_basis_projection(spark, sf_dir):
    edges, _ = _sheet(spark, sf_dir)
    pairs = edges.collect()  # the sheet's 224 edges
    basis = K.smooth_basis([sorted(r["dst"] for r in pairs if r["src"] == d) for d in range(64)], 6)
    power = F.array(*[V.dot("x", F.array(*map(F.lit, map(float, b)))) for b in basis.T])
    return T.patterns(spark, sf_dir).select("vec_id", F.round(V.dot(power, power), 6).alias("smooth_power"))


@query("K07 N02 J14", f"WITH {SQL_SHEET} SELECT src, dst FROM ed JOIN mask ON src = mask.d WHERE dst NOT IN (SELECT d FROM mask) AND (SELECT count(*) FROM mask) BETWEEN 1 AND 57")
def border_edges(spark, sf_dir):
    edges, mask = _sheet(spark, sf_dir)
    return N.contour(mask, edges, 64)
