"""Queries of group summaries, masks, selections and spatial statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geomlake.functions import vectors as V
from geomlake.functions.vectors import near6, r6
from geomlake.operators import aggregates as E
from geomlake.operators import blocked
from geomlake.plans import q_geometry as Q2
from geomlake.plans import q_pairs as Q
from geomlake.plans.registry import query
from geomlake.sources import tables as T


@query("E01", f"WITH {T.SQL_SUB} SELECT unit, block, round(avg(value) + 1.7e-10, 6) + 0.0 AS m, count(*) AS n FROM sub GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT subject) FROM sub)")
def group_average(spark, sf_dir):
    s = T.subjects(spark, sf_dir)
    n = s.agg(F.count_distinct("subject").alias("all"))
    means = s.groupBy("unit", "block").agg(near6(F.avg("value")).alias("m"), F.count("*").alias("n"))
    return means.join(F.broadcast(n), F.col("n") == F.col("all")).drop("all")  # one row


@query("E02", f"WITH {Q2.SQL_MAPS} SELECT count(*) AS n, round(avg(av), 6) AS m, round(stddev_samp(av) / sqrt(count(av)), 6) AS sem, round(avg((av > a)::INT), 6) AS share FROM mp")
def group_mean_sem_frac(spark, sf_dir):
    return Q2._maps(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("av"), 6).alias("m"), F.round(F.stddev_samp("av") / F.sqrt(F.count("av")), 6).alias("sem"), F.round(F.avg((F.col("av") > F.col("a")).cast("int")), 6).alias("share"))


@query("E03", "SELECT o_custkey % 25 AS unit, round(avg(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END), 4) AS m, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS n FROM orders GROUP BY 1 HAVING count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) >= 20")
def nanmean_guard(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    rows = T.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("unit"), F.when(~F.isnan(v), v).alias("v"))
    return rows.groupBy("unit").agg(F.round(F.avg("v"), 4).alias("m"), F.count("v").alias("n")).where("n >= 20")


@query("E04", f"WITH {T.SQL_S}, g AS (SELECT run, k, (k // 24) % 4 AS state, CASE WHEN unit IN ('view', 'click') THEN 'browse' ELSE 'act' END AS net, avg(value) AS v FROM s GROUP BY ALL), m AS (SELECT state, net, avg(v) AS m, count(*) AS n FROM g GROUP BY ALL) SELECT CAST(state AS INT) AS state, net, n, round(m, 6) AS m, round(m - avg(m) OVER (PARTITION BY net), 6) + 0.0 AS dev FROM m")
def state_network_matrix(spark, sf_dir):
    net = F.when(F.col("unit").isin("view", "click"), "browse").otherwise("act")
    state = (F.floor(F.col("k") / 24) % 4).cast("int")
    g = T.signal(spark, sf_dir).groupBy("run", "k", state.alias("state"), net.alias("net")).agg(F.avg("value").alias("v"))
    m = g.groupBy("state", "net").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return m.select("state", "net", "n", F.round("m", 6).alias("m"), r6(F.col("m") - F.avg("m").over(Window.partitionBy("net"))).alias("dev"))


@query("E05", f"WITH {T.SQL_E}, m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL), z AS (SELECT label, d, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM m WINDOW w AS (PARTITION BY label)), r AS (SELECT a.label, b.label AS other, sum(a.z * b.z) / 64 AS r FROM z a JOIN z b ON a.d = b.d AND a.label <> b.label GROUP BY ALL) SELECT label, round(avg(abs(r)), 6) AS mean_abs, round(max(abs(r)), 6) AS max_abs FROM r GROUP BY label")
def cluster_profiles(spark, sf_dir):
    w = Window.partitionBy("label")
    m = T.long_patterns(spark, sf_dir).groupBy("label", "d").agg(F.avg("x").alias("x"))
    z = m.select("label", "d", ((F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w)).alias("z"))
    r = z.join(z.toDF("other", "d", "y"), "d").where("label <> other").groupBy("label", "other").agg((F.sum(F.col("z") * F.col("y")) / 64).alias("r"))
    return r.groupBy("label").agg(F.round(F.avg(F.abs("r")), 6).alias("mean_abs"), F.round(F.max(F.abs("r")), 6).alias("max_abs"))


@query("E07", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rk, sum(n) OVER (PARTITION BY p_brand) AS total, count(*) OVER (PARTITION BY p_brand) AS n_types FROM c) SELECT p_brand, string_agg(p_type, ',' ORDER BY rk) FILTER (rk <= 3) AS top3, round(max(n) / any_value(total), 6) AS purity, any_value(n_types) AS n_types, CASE WHEN max(n) / any_value(total) >= 0.25 THEN 'anatomical' ELSE 'mixed' END AS verdict FROM r GROUP BY p_brand")
def atlas_top3(spark, sf_dir):
    c = T.read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_type"))), 1, 3)
    purity = F.max("n") / F.sum("n")
    return c.groupBy("p_brand").agg(F.array_join(F.transform(top, lambda x: x["p_type"]), ",").alias("top3"), F.round(purity, 6).alias("purity"), F.count("*").alias("n_types"), F.when(purity >= 0.25, "anatomical").otherwise("mixed").alias("verdict"))


@query("E08 R04", "WITH t AS (SELECT p_type, p_brand AS cond, count(*) FILTER (l_discount < 0.03) AS n_sig, round(avg(l_discount), 9) AS effect FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL) SELECT p_type, arg_max(cond, (n_sig, effect, cond)) AS best, max(n_sig) AS n_sig FROM t GROUP BY p_type")
def classify_argmax(spark, sf_dir):
    part = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.col("p_brand").alias("cond"))
    t = T.read(spark, sf_dir, "lineitem").select("l_partkey", "l_discount").join(part, "l_partkey")
    t = t.groupBy("p_type", "cond").agg(F.count_if(F.col("l_discount") < 0.03).alias("n_sig"), F.round(F.avg("l_discount"), 9).alias("effect"))
    return t.groupBy("p_type").agg(F.max_by("cond", F.struct("n_sig", "effect", "cond")).alias("best"), F.max("n_sig").alias("n_sig"))


_PRED = "SELECT l_returnflag || l_linestatus AS unit, year(l_shipdate)::INT AS clip, l_extendedprice AS y, l_quantity * 2100.0 AS p FROM lineitem"


def _predictions(spark, sf_dir):
    return T.read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("unit"), F.year("l_shipdate").alias("clip"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0).alias("p"))


@query("E09", f"WITH t AS ({_PRED}), m AS (SELECT *, avg(y) OVER (PARTITION BY unit) AS m FROM t) SELECT unit, count(*) AS n, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) + 0.0 AS r2, round(corr(y, p), 6) AS r FROM m GROUP BY unit")
def r2_pooled(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return E.r2(rows, "y", "p", "unit").join(rows.groupBy("unit").agg(F.round(F.corr("y", "p"), 6).alias("r")), "unit").select("unit", "n", r6("r2").alias("r2"), "r")


@query("E09", f"WITH t AS ({_PRED}), m AS (SELECT *, avg(y) OVER (PARTITION BY unit) AS m FROM t) SELECT unit, clip, count(*) AS n, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) + 0.0 AS r2 FROM m GROUP BY ALL")
def r2_by_clip(spark, sf_dir):
    return E.r2(_predictions(spark, sf_dir), "y", "p", "unit", "clip", whole=("unit",)).select("unit", "clip", "n", r6("r2").alias("r2"))


@query("E11", "WITH t AS (SELECT l_returnflag AS unit, corr(l_extendedprice, l_quantity) AS pa, corr(l_extendedprice, l_discount) AS pv, corr(l_extendedprice, l_tax) AS pj, corr(l_quantity, l_discount) AS av, corr(l_quantity, l_tax) AS aj, corr(l_discount, l_tax) AS vj FROM lineitem GROUP BY 1), r AS (SELECT unit, pa * pa AS a, pv * pv AS v, pj * pj AS j, (pa * pa + pv * pv - 2 * pa * pv * av) / (1 - av * av) AS av, (pa * pa + pj * pj - 2 * pa * pj * aj) / (1 - aj * aj) AS aj, (pv * pv + pj * pj - 2 * pv * pj * vj) / (1 - vj * vj) AS vj, (pa * pa * (1 - vj * vj) + pv * pv * (1 - aj * aj) + pj * pj * (1 - av * av) + 2 * (pa * pv * (aj * vj - av) + pa * pj * (av * vj - aj) + pv * pj * (av * aj - vj))) / (1 + 2 * av * aj * vj - av * av - aj * aj - vj * vj) AS f FROM t) SELECT unit, round(f, 6) AS full_r2, round(f - vj, 6) + 0.0 AS unique_a, round(f - aj, 6) + 0.0 AS unique_v, round(f - av, 6) + 0.0 AS unique_j, round(aj + vj - j - f + a + v + j - av - aj - vj + f, 6) + 0.0 AS shared_av FROM r")
def variance_partition(spark, sf_dir):
    from geomlake.operators import geometry as G

    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("v"), F.col("l_tax").alias("j"))
    c = rows.groupBy("unit").agg(*[F.corr(p, q).alias(p + q) for p, q in ("ya", "yv", "yj", "av", "aj", "vj")])
    y, g = {n: F.col("y" + n) for n in "avj"}, {n: F.col(n) for n in ("av", "aj", "vj")}
    r = {n: y[n] * y[n] for n in "avj"} | {n: G.r2_two(y[n[0]], y[n[1]], g[n]) for n in g} | {"avj": G.r2_three([y["a"], y["v"], y["j"]], g["av"], g["aj"], g["vj"])}
    parts = G.partition(r)
    return c.select("unit", F.round(r["avj"], 6).alias("full_r2"), *[r6(parts[n]).alias(n) for n in ("unique_a", "unique_v", "unique_j")], r6(parts["shared_av_only"] + parts["shared_avj"]).alias("shared_av"))


@query("E12", f"WITH {T.SQL_SUB}, c AS (SELECT subject, avg(value) FILTER (unit = 'AF') AS own, unit, avg(value) AS v FROM sub GROUP BY subject, unit), o AS (SELECT subject, max(own) AS own FROM c GROUP BY subject), d AS (SELECT c.subject, c.unit, o.own - c.v AS gain FROM c JOIN o USING (subject) WHERE c.unit <> 'AF') SELECT subject, round(avg(gain), 6) + 0.0 AS mean_gain, round(min(gain), 6) + 0.0 AS min_gain, count(*) FILTER (gain > 0) AS wins FROM d GROUP BY subject")
def own_vs_controls(spark, sf_dir):
    m = T.subjects(spark, sf_dir).groupBy("subject", "unit").agg(F.avg("value").alias("v"))
    own = F.max(F.when(F.col("unit") == "AF", F.col("v"))).over(Window.partitionBy("subject"))
    gain = F.col("own") - F.col("v")
    return m.withColumn("own", own).where("unit <> 'AF'").groupBy("subject").agg(r6(F.avg(gain)).alias("mean_gain"), r6(F.min(gain)).alias("min_gain"), F.count_if(gain > 0).alias("wins"))


@query("E13", f"WITH {T.SQL_V}, t AS (SELECT vec_id, label, x[1] AS a, x[2] AS b, row_number() OVER (PARTITION BY label ORDER BY x[1], vec_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM v) SELECT label, CAST(floor(rk / (n + 1.0) * 10) AS INT) AS decile, count(*) AS n, round(avg(b), 6) + 0.0 AS m, round(quantile_cont(b, 0.9), 6) + 0.0 AS p90 FROM t GROUP BY ALL")
def decile_table(spark, sf_dir):
    w = Window.partitionBy("label")
    t = T.patterns(spark, sf_dir).select("label", F.col("x")[1].alias("b"), F.row_number().over(w.orderBy(F.col("x")[0], "vec_id")).alias("rk"), F.count("*").over(w).alias("n"))
    return t.groupBy("label", F.floor(F.col("rk") / (F.col("n") + 1.0) * 10).cast("int").alias("decile")).agg(F.count("*").alias("n"), r6(F.avg("b")).alias("m"), r6(F.percentile("b", F.lit(0.9))).alias("p90"))


SQL_CL = T.SQL_V + ", k AS (SELECT label, count(*) AS n FROM v GROUP BY label), pd AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s FROM v a JOIN v b ON true GROUP BY ALL), sl AS (SELECT pd.vec_id, pd.label, max(CASE WHEN other = pd.label THEN s / (n - 1) END) AS a, min(CASE WHEN other <> pd.label THEN s / n END) AS b FROM pd JOIN k ON other = k.label GROUP BY ALL)"


@query("E14", f"WITH {SQL_CL} SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM sl GROUP BY label")
def cluster_report(spark, sf_dir):
    m = blocked.group_means(T.patterns(spark, sf_dir))
    same = F.col("label") == F.col("other")
    s = m.groupBy("i", "label").agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    return s.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


@query("E14", f"WITH {T.SQL_E}, c AS (SELECT label, d, avg(x) AS c, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT d, avg(x) AS g FROM e GROUP BY d), w AS (SELECT sum((x - c) ** 2) AS ssw, count(DISTINCT vec_id) AS n, count(DISTINCT e.label) AS k FROM e JOIN c USING (label, d)), b AS (SELECT sum(n * (c - g) ** 2) AS ssb FROM c JOIN g USING (d)) SELECT round(ssb / (k - 1) / (ssw / (n - k)), 6) AS calinski_harabasz, n, k FROM w, b")
def calinski_harabasz(spark, sf_dir):
    e = T.long_patterns(spark, sf_dir)
    c = e.groupBy("label", "d").agg(F.avg("x").alias("c"), F.count("*").alias("m"), F.var_pop("x").alias("v"), F.sum("x").alias("s"))
    w = Window.partitionBy("d")
    c = c.withColumn("g", F.sum("s").over(w) / F.sum("m").over(w))
    t = c.agg(F.sum(F.col("v") * F.col("m")).alias("ssw"), F.sum(F.col("m") * (F.col("c") - F.col("g")) ** 2).alias("ssb"), (F.sum("m") / F.count_distinct("d")).cast("bigint").alias("n"), F.count_distinct("label").alias("k"))
    return t.select(F.round(F.col("ssb") / (F.col("k") - 1) / (F.col("ssw") / (F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"), "n", "k")


@query("E15", "WITH s AS (SELECT c_nationkey AS grp, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL), p AS (SELECT grp, n / sum(n) OVER (PARTITION BY grp) AS p FROM s) SELECT grp, count(*) AS k, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) + 0.0 AS entropy FROM p GROUP BY grp")
def selection_score(spark, sf_dir):
    s = T.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("grp"), "c_mktsegment").agg(F.count("*").alias("n"))
    return E.balance_entropy(s, "n", "grp").select("grp", "k", r6("entropy").alias("entropy"))


_MASKS = "SELECT lang, quality = 0 AS a, toxic = 1 OR n_chars > 2000 AS b FROM documents JOIN labels USING (doc_id)"


def _masks(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(T.read(spark, sf_dir, "labels"), "doc_id")
    return d.select("lang", (F.col("quality") == 0).alias("a"), ((F.col("toxic") == 1) | (F.col("n_chars") > 2000)).alias("b"))


@query("E16 U04", f"WITH m AS ({_MASKS}) SELECT lang, round(2.0 * count(*) FILTER (a AND b) / (count(*) FILTER (a) + count(*) FILTER (b)), 6) AS dice, round(count(*) FILTER (a AND b)::DOUBLE / count(*) FILTER (a OR b), 6) AS jaccard FROM m GROUP BY lang")
def dice_jaccard(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _masks(spark, sf_dir).groupBy("lang").agg(F.round(E.dice(a, b), 6).alias("dice"), F.round(E.jaccard(a, b), 6).alias("jaccard"))


@query("F03 U04", f"WITH {T.SQL_V} SELECT vec_id, CASE WHEN x[1] > 0.1 AND x[2] > 0.1 THEN CASE WHEN x[1] >= x[2] THEN 'a' ELSE 'b' END WHEN x[1] > 0.1 THEN 'a' WHEN x[2] > 0.1 THEN 'b' ELSE 'none' END AS winner, (x[1] > 0.1) AND (x[2] > 0.1) AS overlap FROM v")
def mask_overlap(spark, sf_dir):
    a, b = F.col("x")[0], F.col("x")[1]
    in_a, in_b = a > 0.1, b > 0.1
    winner = F.when(in_a & in_b, F.when(a >= b, "a").otherwise("b")).when(in_a, "a").when(in_b, "b").otherwise("none")
    return T.patterns(spark, sf_dir).select("vec_id", winner.alias("winner"), (in_a & in_b).alias("overlap"))


@query("F02", f"WITH {T.SQL_V}, t AS (SELECT vec_id, label, x[1] AS a FROM v), c AS (SELECT avg(a) + stddev_pop(a) AS sd1, quantile_cont(a, 0.95) AS p95 FROM t) SELECT vec_id, a > sd1 AS above_sd, a >= p95 AS above_p95 FROM t, c")
def threshold_masks(spark, sf_dir):
    t = T.patterns(spark, sf_dir).select("vec_id", F.col("x")[0].alias("a"))
    cuts = t.agg((F.avg("a") + F.stddev_pop("a")).alias("sd1"), F.percentile("a", F.lit(0.95)).alias("p95"))
    return t.join(F.broadcast(cuts)).select("vec_id", (F.col("a") > F.col("sd1")).alias("above_sd"), (F.col("a") >= F.col("p95")).alias("above_p95"))  # one row


@query("F02 R06", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT CAST(ceil(count(*) * 2.5 / 100) AS BIGINT) FROM part)")
def top_percent(spark, sf_dir):
    return E.top_percent(T.read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 2.5, "p_partkey")


@query("F04", f"WITH {T.SQL_V} SELECT vec_id, round(list_sum(list_transform(list_filter(range(64), lambda i: i % 7 = 3), lambda i: x[i + 1])), 6) + 0.0 AS s FROM v")
def channel_subset(spark, sf_dir):
    kept = F.filter("x", lambda _, i: i % 7 == 3)
    return T.patterns(spark, sf_dir).select("vec_id", r6(V.total(kept)).alias("s"))


@query("F05", f"WITH {T.SQL_V}, seeds AS (SELECT label, arg_min(x, vec_id) AS c FROM v GROUP BY label) SELECT v.label, vec_id FROM v JOIN seeds USING (label) WHERE sqrt((x[1] - c[1]) ** 2 + (x[2] - c[2]) ** 2 + (x[3] - c[3]) ** 2) <= 0.15")
def sphere_filter(spark, sf_dir):
    v = T.patterns(spark, sf_dir)
    seeds = v.groupBy("label").agg(F.min_by("x", "vec_id").alias("c"))
    far = V.squared_distance(F.slice("x", 1, 3), F.slice("c", 1, 3))
    return v.join(seeds, "label").where(F.sqrt(far) <= 0.15).select("label", "vec_id")


_LABELLED = f"WITH {T.SQL_V}, r AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN -1 ELSE label * 10 END AS raw FROM v)"


@query("K05", _LABELLED + ", k AS (SELECT raw, row_number() OVER (ORDER BY raw) AS key FROM (SELECT DISTINCT raw FROM r WHERE raw <> -1)) SELECT vec_id, CAST(raw AS INT) AS raw, CAST(coalesce(key, 0) AS INT) AS key FROM r LEFT JOIN k USING (raw)")
def label_remap(spark, sf_dir):
    raw = F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label") * 10)
    return E.relabelled(T.patterns(spark, sf_dir).select("vec_id", raw.cast("int").alias("raw")), "raw")


@query("F06 A11", "WITH l AS (SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE toxic END AS raw FROM labels), m AS (SELECT max(raw) AS m FROM l) SELECT doc_id, CAST(CASE WHEN raw IS NULL THEN -1 WHEN raw = -1 THEN m + 1 ELSE raw END AS INT) AS full_label FROM documents LEFT JOIN l USING (doc_id), m")
def scatter_left_join(spark, sf_dir):
    l = T.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, -1).otherwise(F.col("toxic")).alias("raw"))
    rows = T.read(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").join(F.broadcast(l.agg(F.max("raw").alias("m"))))  # one row
    return rows.select("doc_id", F.when(F.col("raw").isNull(), -1).when(F.col("raw") == -1, F.col("m") + 1).otherwise(F.col("raw")).cast("int").alias("full_label"))


@query("A10", f"WITH {T.SQL_E}, z AS (SELECT vec_id, d, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, round(max(z), 6) AS high, round(min(z), 6) AS low, round(sum(z * z), 4) AS q FROM z GROUP BY vec_id")
def row_zscore(spark, sf_dir):
    z = T.patterns(spark, sf_dir).select("vec_id", V.zscore("x").alias("z"))
    return z.select("vec_id", F.round(F.array_max("z"), 6).alias("high"), F.round(F.array_min("z"), 6).alias("low"), F.round(V.dot("z", "z"), 4).alias("q"))


@query("A15", "SELECT lang, bit_or(1::BIGINT << (n_chars % 60)) AS packed, bit_count(bit_or(1::BIGINT << (n_chars % 60)))::INT AS n FROM documents GROUP BY lang")
def bitmap_stack(spark, sf_dir):
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n_chars") % 60).cast("int"))
    return T.read(spark, sf_dir, "documents").groupBy("lang").agg(F.bit_or(bit).alias("packed"), F.bit_count(F.bit_or(bit)).alias("n"))


@query("E17", f"WITH {Q.SQL_GRID}, {T.SQL_E}, m AS (SELECT d, avg(x) AS m FROM e GROUP BY d), t AS (SELECT CASE WHEN row < 4 THEN 'n' ELSE 's' END AS tower, d, m FROM g JOIN m USING (d)) SELECT coalesce(tower, 'all') AS tower, count(*) AS n, round(avg(m), 6) + 0.0 AS m, arg_max(d, (m, -d)) AS peak FROM t GROUP BY ROLLUP (tower)")
def tower_summary(spark, sf_dir):
    m = T.long_patterns(spark, sf_dir).groupBy("d").agg(F.avg("x").alias("m"))
    t = Q.grid(spark).join(m, "d").select(F.when(F.col("row") < 4, "n").otherwise("s").alias("tower"), "d", "m")
    return t.rollup("tower").agg(F.count("*").alias("n"), r6(F.avg("m")).alias("m"), F.max_by("d", F.struct("m", -F.col("d"))).alias("peak")).select(F.coalesce("tower", F.lit("all")).alias("tower"), "n", "m", "peak")


@query("E18", f"WITH {Q.SQL_GRID}, {T.SQL_E}, f AS (SELECT label, row, col, avg(x) AS v FROM e JOIN g USING (d) GROUP BY ALL), z AS (SELECT label, row, col, v - avg(v) OVER (PARTITION BY label) AS z FROM f), l AS (SELECT a.label, sum(a.z * b.z) AS num, count(*) AS w FROM z a JOIN z b ON a.label = b.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY a.label), o AS (SELECT label, sum(z * z) AS den, count(*) AS n FROM z GROUP BY label) SELECT label, round(n / w * num / den, 6) + 0.0 AS i FROM l JOIN o USING (label)")
def morans_i(spark, sf_dir):
    f = T.long_patterns(spark, sf_dir).join(F.broadcast(Q.grid(spark)), "d").groupBy("label", "row", "col").agg(F.avg("x").alias("value"))
    return E.morans_i(f, "label").select("label", r6("i").alias("i"))


@query("E19", "SELECT p_type, string_agg(DISTINCT CASE WHEN p_size > 25 THEN 'large' WHEN p_retailprice > 1000 THEN 'dear' ELSE 'plain' END, '|' ORDER BY CASE WHEN p_size > 25 THEN 'large' WHEN p_retailprice > 1000 THEN 'dear' ELSE 'plain' END) AS roles, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type")
def dedupe_roles(spark, sf_dir):
    role = F.when(F.col("p_size") > 25, "large").when(F.col("p_retailprice") > 1000, "dear").otherwise("plain")
    return T.read(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set(role)), "|").alias("roles"), F.count_distinct("p_brand").alias("brands"))


@query("R05", "WITH c AS (SELECT p_type, p_size::BIGINT AS dim, round(avg(p_retailprice), 6) AS v FROM part GROUP BY ALL), b AS (SELECT p_type, dim, max(v) OVER (PARTITION BY p_type ORDER BY dim ROWS UNBOUNDED PRECEDING) AS v FROM c), s AS (SELECT p_type, dim, round((v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-30) - (dim - min(dim) OVER w) / greatest(max(dim) OVER w - min(dim) OVER w, 1e-30), 12) AS gap FROM b WINDOW w AS (PARTITION BY p_type)) SELECT p_type, arg_max(dim, (gap, -dim)) AS dim FROM s GROUP BY p_type")
def elbow(spark, sf_dir):
    c = T.read(spark, sf_dir, "part").groupBy("p_type", F.col("p_size").cast("long").alias("dim")).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    return E.elbow(c, "dim", "v", "p_type")


@query("R09", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) DESC) AS INT) AS place FROM customer")
def natural_sort(spark, sf_dir):
    part = F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")
    return T.read(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(part.desc())).alias("place"))


@query("R10", "SELECT vec_id FROM embeddings ORDER BY (vec_id * 7919 + 42 * 104729) % 1000003, vec_id LIMIT 100")
def hash_free_sample(spark, sf_dir):
    return E.sample(T.read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 100, 42)


@query("M17 U01", f"WITH {T.SQL_V} SELECT vec_id FROM v WHERE x[1] > 0.2 UNION SELECT vec_id FROM v WHERE x[2] > 0.2 UNION SELECT vec_id FROM v WHERE label = 3 AND x[3] > 0.1")
def readout_union(spark, sf_dir):
    v, x = T.patterns(spark, sf_dir), F.col("x")
    parts = [v.where(x[0] > 0.2), v.where(x[1] > 0.2), v.where((F.col("label") == 3) & (x[2] > 0.1))]
    return parts[0].select("vec_id").union(parts[1].select("vec_id")).union(parts[2].select("vec_id")).distinct()


@query("U03 S20", "SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1")
def pending_difference(spark, sf_dir):
    done = T.read(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return T.read(spark, sf_dir, "supplier").select("s_suppkey").join(done, "s_suppkey", "left_anti")


@query("M05", f"WITH {T.SQL_E}, w AS (SELECT d, c, cos((d::DOUBLE + 0.5) * c * 3.141592653589793 / 64) AS w FROM (SELECT unnest(range(64))::INT AS d), (SELECT unnest(range(5))::INT AS c)) SELECT vec_id, c, round(sum(x * w), 6) + 0.0 AS y FROM e JOIN w USING (d) GROUP BY ALL")
def weighted_projection(spark, sf_dir):
    w = spark.range(64 * 5).select((F.col("id") / 5).cast("int").alias("d"), (F.col("id") % 5).cast("int").alias("c"))
    w = w.withColumn("w", F.cos((F.col("d") + 0.5) * F.col("c") * 3.141592653589793 / 64))
    return T.long_patterns(spark, sf_dir).join(F.broadcast(w), "d").groupBy("vec_id", "c").agg(r6(F.sum(F.col("x") * F.col("w"))).alias("y"))
