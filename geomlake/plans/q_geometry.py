"""Queries of representational geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geomlake.functions import ranks
from geomlake.functions import vectors as V
from geomlake.functions.vectors import r6
from geomlake.operators import aggregates, blocked, ranking
from geomlake.operators import geometry as G
from geomlake.operators import pairs as P
from geomlake.plans import q_pairs as Q
from geomlake.plans.registry import query
from geomlake.sources import tables as T

#: Three bands of features: name, first (from 1), last.
BANDS = (("a", 1, 20), ("v", 21, 40), ("j", 41, 64))


#: Squared distances da, dv, dj of the bands, d of all features.
RDMS = {f"d{n}": blocked.band(blocked.squared, first, last) for n, first, last in BANDS} | {"d": blocked.squared}


def correlated(spark, sf_dir, *wanted):
    """label, n and the correlation <u>_<v> of the ranks of each two wanted distances."""
    measures = {u: m for u, m in RDMS.items() if any(u in two for two in wanted)}
    return ranking.correlations(T.patterns(spark, sf_dir), measures, list(wanted))


SQL_B = T.SQL_V + ", pb AS (SELECT s.label, s.vec_id AS i, t.vec_id AS j, " + ", ".join(f"list_distance(s.x[{s}:{e}], t.x[{s}:{e}]) ** 2 AS d{n}" for n, s, e in BANDS) + ", list_distance(s.x, t.x) ** 2 AS d FROM v s JOIN v t ON s.label = t.label AND s.vec_id > t.vec_id)"
SQL_BR = SQL_B + ", br AS (SELECT label, i, j, " + ", ".join(f"rank() OVER (PARTITION BY label ORDER BY {c}) + (count(*) OVER (PARTITION BY label, {c}) - 1) / 2.0 AS r{c}" for c in ("da", "dv", "dj", "d")) + " FROM pb)"


@query("G07 J10", f"WITH {SQL_BR}, c AS (SELECT label, count(*) AS n, corr(rdj, rda) AS rho FROM br GROUP BY label) SELECT label, n, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 5) AS t FROM c")
def parcel_rsa(spark, sf_dir):
    c = correlated(spark, sf_dir, ("dj", "da")).withColumnRenamed("dj_da", "rho")
    return c.select("label", "n", F.round("rho", 6).alias("rho"), F.round(F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))), 5).alias("t"))


_PARTIAL = "CASE WHEN (1 - {xz} * {xz}) * (1 - {yz} * {yz}) > 1e-20 THEN ({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})) ELSE 0 END"


@query("G08", f"WITH {SQL_BR}, c AS (SELECT label, corr(rd, rdj) AS xy, corr(rd, rda) AS xz, corr(rdj, rda) AS yz FROM br GROUP BY label) SELECT label, round({_PARTIAL.format(xy='xy', xz='xz', yz='yz')}, 6) + 0.0 AS r FROM c")
def partial_rsa_1(spark, sf_dir):
    c = correlated(spark, sf_dir, ("d", "dj"), ("d", "da"), ("dj", "da"))
    return c.select("label", r6(ranks.partial(F.col("d_dj"), F.col("d_da"), F.col("dj_da"))).alias("r"))


@query("G08", f"WITH {SQL_BR}, c AS (SELECT label, corr(rd, rdj) AS yx, corr(rd, rda) AS y1, corr(rdj, rda) AS x1, corr(rd, rdv) AS y2, corr(rdv, rda) AS z12, corr(rdj, rdv) AS x2 FROM br GROUP BY label), d AS (SELECT label, {_PARTIAL.format(xy='yx', xz='y1', yz='x1')} AS p, {_PARTIAL.format(xy='y2', xz='y1', yz='z12')} AS q, {_PARTIAL.format(xy='x2', xz='x1', yz='z12')} AS w FROM c) SELECT label, round({_PARTIAL.format(xy='p', xz='q', yz='w')}, 6) + 0.0 AS r FROM d")
def partial_rsa_2(spark, sf_dir):
    c = correlated(spark, sf_dir, ("d", "dj"), ("d", "da"), ("d", "dv"), ("dj", "da"), ("dj", "dv"), ("dv", "da"))
    return c.select("label", r6(G.partial_2("d", "dj", "da", "dv", lambda a, b: F.col(f"{a}_{b}"))).alias("r"))


@query("G27 G08 U01", f"WITH {SQL_BR}, c AS (SELECT label, corr(rd, rda) AS a, corr(rd, rdv) AS v, corr(rd, rdj) AS j FROM br GROUP BY label) SELECT label, round(a, 6) AS a, round(v, 6) AS v, round(j, 6) AS j, round(j - greatest(a, v), 6) + 0.0 AS gain FROM c")
def partial_corr_suite(spark, sf_dir):
    c = correlated(spark, sf_dir, ("d", "da"), ("d", "dv"), ("d", "dj"))
    return c.select("label", *[F.round(f"d_d{n}", 6).alias(n) for n in "avj"], r6(F.col("d_dj") - F.greatest("d_da", "d_dv")).alias("gain"))


SQL_SEARCH = f"WITH {Q.SQL_GRID}, {T.SQL_E}, near AS (SELECT centre, nbr FROM gn WHERE rk <= 6)"


def _neighbours(spark, k):
    rows = Q.grid_neighbours(spark, k).collect()  # the sheet's 64 places
    return {c: sorted(r["nbr"] for r in rows if r["centre"] == c) for c in range(64)}


@query("G05 J02 J06", SQL_SEARCH + """, f AS (SELECT label, vec_id, centre, nbr, x - avg(x) OVER (PARTITION BY vec_id, centre) AS x FROM e JOIN near ON d = nbr
 UNION ALL SELECT label, vec_id, -1, d, x - avg(x) OVER (PARTITION BY vec_id) FROM e WHERE d >= 32), u AS (SELECT label, vec_id, centre, nbr, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id, centre)) AS x FROM f),
 p AS (SELECT a.label, a.centre, a.vec_id AS i, b.vec_id AS j, round(1 - sum(a.x * b.x), 12) AS d FROM u a JOIN u b ON a.label = b.label AND a.centre = b.centre AND a.nbr = b.nbr AND a.vec_id > b.vec_id GROUP BY ALL),
 r AS (SELECT label, centre, i, j, rank() OVER (PARTITION BY label, centre ORDER BY d) + (count(*) OVER (PARTITION BY label, centre, d) - 1) / 2.0 AS r FROM p)
 SELECT s.label, s.centre, round(corr(s.r, m.r), 4) + 0.0 AS rho FROM r s JOIN r m ON s.label = m.label AND s.i = m.i AND s.j = m.j AND m.centre = -1 WHERE s.centre >= 0 GROUP BY ALL""")
def searchlight_rsa(spark, sf_dir):
    found = ranking.searchlights(T.patterns(spark, sf_dir), _neighbours(spark, 6), list(range(32, 64)))
    return found.select("label", "centre", (F.round("value", 4) + 0.0).alias("rho"))


@query("G12 G11 J02", SQL_SEARCH + """, f AS (SELECT label, vec_id, centre, nbr, x - avg(x) OVER (PARTITION BY label, centre, nbr) AS x FROM e JOIN near ON d = nbr
 UNION ALL SELECT label, vec_id, -1, d, x - avg(x) OVER (PARTITION BY label, d) FROM e WHERE d >= 32),
 p AS (SELECT a.label, a.centre, a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS k FROM f a JOIN f b ON a.label = b.label AND a.centre = b.centre AND a.nbr = b.nbr GROUP BY ALL)
 SELECT s.label, s.centre, round(sum(s.k * m.k) / sqrt(sum(s.k * s.k) * sum(m.k * m.k)), 6) AS cka FROM p s JOIN p m ON s.label = m.label AND s.i = m.i AND s.j = m.j AND m.centre = -1 WHERE s.centre >= 0 GROUP BY ALL""")
def searchlight_cka(spark, sf_dir):
    found = G.searchlight_cka(T.patterns(spark, sf_dir), _neighbours(spark, 6), list(range(32, 64)))
    return found.select("label", "centre", F.round("value", 6).alias("cka"))


@query("G28 H03", f"WITH {SQL_BR}, {Q.SQL_PERM}, n AS (SELECT label, i, j, row_number() OVER (PARTITION BY label ORDER BY i, j) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, rda, rdv, rdj FROM br), o AS (SELECT label, corr(rdj, rda) AS a, corr(rdj, rdv) AS v FROM br GROUP BY label), q AS (SELECT x.label, p, corr(x.rdj, y.rda) - corr(x.rdj, y.rdv) AS delta FROM n x JOIN pm ON true JOIN n y ON x.label = y.label AND y.k = (x.k + off) % x.n GROUP BY ALL) SELECT label, round(any_value(a - v), 6) + 0.0 AS delta, CAST(count(*) FILTER (abs(q.delta) >= abs(a - v) - 1e-12) AS BIGINT) AS hits FROM q JOIN o USING (label) GROUP BY label")
def full_sheet_pair(spark, sf_dir):
    shifts = Q.shifts(spark, 20, 64)
    rows = ranking.shifted(T.patterns(spark, sf_dir), RDMS["dj"], {n: RDMS[n] for n in ("da", "dv")}, [0, *sorted({r["off"] for r in shifts.collect()})])  # 20 shifts
    rows = rows.select("label", "off", (F.col("r_da") - F.col("r_dv")).alias("null"))
    seen = F.max(F.when(F.col("off") == 0, F.col("null"))).over(Q.Window.partitionBy("label"))
    return rows.withColumn("delta", seen).join(F.broadcast(shifts), "off").groupBy("label").agg(r6(F.first("delta")).alias("delta"), F.count_if(F.abs("null") >= F.abs("delta") - 1e-12).alias("hits"))


SQL_X = T.SQL_SUB + ", pr AS (SELECT a.subject, a.unit, a.block AS t1, b.block AS t2, a.value - b.value AS delta FROM sub a JOIN sub b ON a.subject = b.subject AND a.unit = b.unit AND a.block > b.block)"


def _block_pairs(spark, sf_dir):
    s = T.subjects(spark, sf_dir)
    pairs = P.within(s, "block", "subject", "unit")
    return pairs.select("subject", "unit", F.col("a.block").alias("t1"), F.col("b.block").alias("t2"), (F.col("a.value") - F.col("b.value")).alias("delta"))


@query("G09", f"WITH {SQL_X}, u AS (SELECT t1, t2, unit, sum(delta) AS s, sum(delta * delta) AS q, count(*) AS n FROM pr GROUP BY ALL) SELECT t1, t2, round(sum((s * s - q) / (n * (n - 1))), 5) + 0.0 AS d, max(n) AS n FROM u GROUP BY ALL")
def crossnobis(spark, sf_dir):
    found = G.crossnobis(_block_pairs(spark, sf_dir), "t1", "t2")
    return found.select("t1", "t2", (F.round("d", 5) + 0.0).alias("d"), "n")


@query("G10", f"WITH {SQL_X}, s AS (SELECT subject, t1 * 10000 + t2 AS pair, sqrt(sum(delta * delta)) AS d FROM pr GROUP BY ALL), m AS (SELECT *, avg(d) OVER w AS m, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY pair)), c AS (SELECT subject, corr(d, m) AS up, corr(d, (n * m - d) / (n - 1)) AS lo FROM m GROUP BY subject) SELECT round(avg(up), 6) AS upper, round(avg(lo), 6) + 0.0 AS lower, count(*) AS n FROM c")
def noise_ceiling_rsa(spark, sf_dir):
    d = _block_pairs(spark, sf_dir).groupBy("subject", (F.col("t1") * 10_000 + F.col("t2")).alias("pair")).agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("d"))
    return G.noise_ceiling(d).select(F.round("upper", 6).alias("upper"), r6("lower").alias("lower"), "n")


SQL_GRAM = T.SQL_V + ", f AS (SELECT label, vec_id, x FROM v), gr AS (SELECT s.label, s.vec_id AS i, t.vec_id AS j, " + ", ".join(f"list_inner_product(s.x[{s}:{e}], t.x[{s}:{e}]) AS k{n}" for n, s, e in BANDS) + ", list_inner_product(s.x, t.x) AS k FROM f s JOIN f t ON s.label = t.label)" + ", cg AS (SELECT label, i, j, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY label, i) - avg({c}) OVER (PARTITION BY label, j) + avg({c}) OVER (PARTITION BY label) AS {c}" for c in ("ka", "kv", "kj", "k")) + " FROM gr)"


def _grams(spark, sf_dir):
    """label, i, j and double-centred Grams ka, kv, kj of the bands and k of all features."""
    measures = {f"k{n}": blocked.band(np.inner, first, last) for n, first, last in BANDS}
    return blocked.within(blocked.centred(T.patterns(spark, sf_dir)), measures | {"k": np.inner}, full=True)


_COS = "sum({0} * {1}) / sqrt(sum({0} * {0}) * sum({1} * {1}))"


@query("G11", f"WITH {SQL_GRAM} SELECT label, round({_COS.format('ka', 'kv')}, 6) AS cka_av, round({_COS.format('k', 'kj')}, 6) AS cka_j, count(*) AS n FROM cg GROUP BY label")
def cka_linear(spark, sf_dir):
    return _grams(spark, sf_dir).groupBy("label").agg(F.round(G.cosine("ka", "kv"), 6).alias("cka_av"), F.round(G.cosine("k", "kj"), 6).alias("cka_j"), F.count("*").alias("n"))


def _cosines(spark, sf_dir):
    names = [("k", n) for n in ("ka", "kv", "kj")] + [("ka", "kv"), ("ka", "kj"), ("kv", "kj")]
    return _grams(spark, sf_dir).groupBy("label").agg(*[G.cosine(a, b).alias(f"{a}_{b}") for a, b in names])


SQL_COS = SQL_GRAM + ", cs AS (SELECT label, " + ", ".join(f"{_COS.format(a, b)} AS {n}" for a, b, n in (("k", "ka", "ca"), ("k", "kv", "cv"), ("k", "kj", "cj"), ("ka", "kv", "av"), ("ka", "kj", "aj"), ("kv", "kj", "vj"))) + " FROM cg GROUP BY label)"


@query("G14", f"WITH {SQL_COS}, w AS (SELECT *, (aj - av * vj) / (1 - av * av) AS wa, (vj - av * aj) / (1 - av * av) AS wv FROM cs) SELECT label, round((cj - wa * ca - wv * cv) / sqrt(1 - wa * aj - wv * vj), 6) + 0.0 AS sp_j FROM w")
def semipartial_cka(spark, sf_dir):
    c = F.col
    own = {("a", "v"): c("ka_kv"), ("a", "j"): c("ka_kj"), ("v", "j"): c("kv_kj")}
    sp = G.semipartial({n: c(f"k_k{n}") for n in "avj"}, own, "j", ("a", "v"))
    return _cosines(spark, sf_dir).select("label", r6(sp).alias("sp_j"))


def _commonality(c: dict, two, three):
    return {"a": c["ca"] * c["ca"], "v": c["cv"] * c["cv"], "j": c["cj"] * c["cj"], "av": two(c["ca"], c["cv"], c["av"]), "aj": two(c["ca"], c["cj"], c["aj"]), "vj": two(c["cv"], c["cj"], c["vj"]), "avj": three}


_TWO = "(({0} * {0} + {1} * {1} - 2 * {0} * {1} * {2}) / (1 - {2} * {2}))"


@query("G15 E11", f"""WITH {SQL_COS}, r AS (SELECT label, ca * ca AS a, cv * cv AS v, cj * cj AS j, {_TWO.format('ca', 'cv', 'av')} AS av, {_TWO.format('ca', 'cj', 'aj')} AS aj, {_TWO.format('cv', 'cj', 'vj')} AS vj,
 (ca * ca * (1 - vj * vj) + cv * cv * (1 - aj * aj) + cj * cj * (1 - av * av) + 2 * (ca * cv * (aj * vj - av) + ca * cj * (av * vj - aj) + cv * cj * (av * aj - vj))) / (1 + 2 * av * aj * vj - av * av - aj * aj - vj * vj) AS f FROM cs)
 SELECT label, round(f - vj, 6) + 0.0 AS unique_a, round(f - aj, 6) + 0.0 AS unique_v, round(f - av, 6) + 0.0 AS unique_j, round(aj + vj - j - f, 6) + 0.0 AS shared_av_only, round(av + vj - v - f, 6) + 0.0 AS shared_aj, round(av + aj - a - f, 6) + 0.0 AS shared_vj, round(a + v + j - av - aj - vj + f, 6) + 0.0 AS shared_avj FROM r""")
def commonality(spark, sf_dir):
    c = {"ca": F.col("k_ka"), "cv": F.col("k_kv"), "cj": F.col("k_kj"), "av": F.col("ka_kv"), "aj": F.col("ka_kj"), "vj": F.col("kv_kj")}
    r = _commonality(c, G.r2_two, G.r2_three([c["ca"], c["cv"], c["cj"]], c["av"], c["aj"], c["vj"]))
    return _cosines(spark, sf_dir).select("label", *[r6(v).alias(k) for k, v in G.partition(r).items()])


SQL_SC = T.SQL_SUB + ", sc AS (SELECT subject, unit, block, value - avg(value) OVER (PARTITION BY subject, unit) AS x FROM sub), sg AS (SELECT a.subject, a.block * 10000 + b.block AS pair, sum(a.x * b.x) AS k FROM sc a JOIN sc b ON a.subject = b.subject AND a.unit = b.unit GROUP BY ALL)"


@query("G13", f"WITH {SQL_SC}, n AS (SELECT *, k / sqrt(sum(k * k) OVER (PARTITION BY subject)) AS u FROM sg), m AS (SELECT *, sum(u) OVER (PARTITION BY pair) AS s FROM n), c AS (SELECT subject, sum(u * s) / sqrt(sum(u * u) * sum(s * s)) AS up, sum(u * (s - u)) / sqrt(sum(u * u) * sum((s - u) * (s - u))) AS lo FROM m GROUP BY subject) SELECT round(avg(up), 6) AS upper, round(avg(lo), 6) AS lower FROM c")
def noise_ceiling_cka(spark, sf_dir):
    w = Q.Window.partitionBy
    x = T.subjects(spark, sf_dir).select("subject", "unit", "block", (F.col("value") - F.avg("value").over(w("subject", "unit"))).alias("x"))
    a, b = x.select("subject", "unit", F.col("block").alias("p"), F.col("x").alias("xa")), x.select("subject", "unit", F.col("block").alias("q"), F.col("x").alias("xb"))
    k = a.join(b, ["subject", "unit"]).groupBy("subject", (F.col("p") * 10_000 + F.col("q")).alias("pair")).agg(F.sum(F.col("xa") * F.col("xb")).alias("k"))
    u = k.select("subject", "pair", (F.col("k") / F.sqrt(F.sum(F.col("k") * F.col("k")).over(w("subject")))).alias("u"))
    s = u.withColumn("s", F.sum("u").over(w("pair"))).withColumn("rest", F.col("s") - F.col("u"))
    each = s.groupBy("subject").agg(G.cosine("u", "s").alias("up"), G.cosine("u", "rest").alias("lo"))
    return each.agg(F.round(F.avg("up"), 6).alias("upper"), F.round(F.avg("lo"), 6).alias("lower"))


@query("G17", f"WITH {T.SQL_V}, t AS (SELECT vec_id, x[1:22] AS a, x[22:43] AS v, x[43:64] AS t FROM v), o AS (SELECT *, list_inner_product(v, a) / greatest(list_inner_product(a, a), 1e-8) AS c, list_inner_product(t, a) / greatest(list_inner_product(a, a), 1e-8) AS ct FROM t), w AS (SELECT vec_id, a, list_transform(range(1, 23), lambda i: v[i] - c * a[i]) AS w, list_transform(range(1, 23), lambda i: t[i] - ct * a[i]) AS r FROM o), z AS (SELECT *, list_inner_product(r, w) / greatest(list_inner_product(w, w), 1e-8) AS k FROM w), f AS (SELECT vec_id, a, w, list_transform(range(1, 23), lambda i: r[i] - k * w[i]) AS f FROM z) SELECT vec_id, round(sqrt(list_inner_product(f, f)), 6) AS norm, round(f[1], 6) + 0.0 AS first FROM f")
def projection_residual(spark, sf_dir):
    a, v, t = (F.slice("x", s, 22) for s in (1, 22, 43))
    rows = T.patterns(spark, sf_dir).select("vec_id", V.projection_residual(t, a, v).alias("f"))
    return rows.select("vec_id", F.round(F.sqrt(V.dot("f", "f")), 6).alias("norm"), r6(F.col("f")[0]).alias("first"))


@query("G19", f"WITH {T.SQL_C}, q AS (SELECT a.vec_id, a.label, a.label = b.label AS same, list_inner_product(a.z, b.z) AS s FROM c a JOIN c b ON a.vec_id <> b.vec_id), t AS (SELECT vec_id, avg(s) FILTER (same) AS d, avg(s) FILTER (NOT same) AS o, stddev_samp(s) FILTER (NOT same) AS sd, count(*) FILTER (NOT same) AS n FROM q GROUP BY vec_id) SELECT vec_id, round(d - o, 6) + 0.0 AS gap, round((d - o) / (sd / sqrt(n)), 5) + 0.0 AS t FROM t")
def diag_vs_offdiag(spark, sf_dir):
    q = P.both_ways(Q.all_pairs(spark, sf_dir).withColumn("s", 1 - F.col("d")).select("i", "j", (F.col("la") == F.col("lb")).alias("same"), "s"))
    other = F.when(~F.col("same"), F.col("s"))
    t = q.groupBy("i").agg(F.avg(F.when(F.col("same"), F.col("s"))).alias("d"), F.avg(other).alias("o"), F.stddev_samp(other).alias("sd"), F.count(other).alias("n"))
    gap = F.col("d") - F.col("o")
    return t.select(F.col("i").alias("vec_id"), r6(gap).alias("gap"), (F.round(gap / (F.col("sd") / F.sqrt("n")), 5) + 0.0).alias("t"))


@query("G20", f"WITH {Q.SQL_GRID}, {T.SQL_E}, z AS (SELECT vec_id, d, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM e WINDOW w AS (PARTITION BY d)), s AS (SELECT vec_id, centre, sum(z) AS s FROM z JOIN gn ON d = nbr WHERE rk <= 8 GROUP BY ALL) SELECT centre, round((sum(s * s) - 8 * count(*)) / (8 * 7 * count(*)), 6) + 0.0 AS homogeneity FROM s GROUP BY centre")
def homogeneity(spark, sf_dir):
    e = T.long_patterns(spark, sf_dir)
    z = e.join(e.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")), "d").select("vec_id", "d", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))
    s = z.join(F.broadcast(Q.grid_neighbours(spark, 8)), F.col("d") == F.col("nbr")).groupBy("vec_id", "centre").agg(F.sum("z").alias("s"))
    return s.groupBy("centre").agg(r6((F.sum(F.col("s") * F.col("s")) - 8 * F.count("*")) / (56 * F.count("*"))).alias("homogeneity"))


@query("G20 E13", f"WITH {Q.SQL_GRID}, {T.SQL_E}, m AS (SELECT d, avg(x) > 0 AS core FROM e GROUP BY d), c AS (SELECT centre, count(*) FILTER (core) AS n FROM gn JOIN m ON d = nbr WHERE rk <= 8 GROUP BY centre) SELECT CAST(ceil(10.0 * n / 8) AS INT) AS ring, count(*) AS units FROM c GROUP BY 1")
def ring_bins(spark, sf_dir):
    core = T.long_patterns(spark, sf_dir).groupBy("d").agg((F.avg("x") > 0).alias("core"))
    n = F.broadcast(Q.grid_neighbours(spark, 8)).join(core, F.col("d") == F.col("nbr")).groupBy("centre").agg(F.count_if("core").alias("n"))
    return n.groupBy(F.ceil(10.0 * F.col("n") / 8).cast("int").alias("ring")).agg(F.count("*").alias("units"))


_SEED = f"WITH {T.SQL_S}, g AS (SELECT run, k, avg(value) AS seed FROM s WHERE unit IN ('view', 'click') GROUP BY ALL)"


def _seeded(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    return s.join(s.where(F.col("unit").isin("view", "click")).groupBy("run", "k").agg(F.avg("value").alias("seed")), ["run", "k"])


@query("G21 A13", _SEED + ", r AS (SELECT unit, run, coalesce(corr(value, seed), 0) AS r FROM s JOIN g USING (run, k) GROUP BY ALL) SELECT unit, round(tanh(avg(atanh(greatest(-0.999999, least(r, 0.999999))))), 6) + 0.0 AS r FROM r GROUP BY unit")
def seed_connectivity(spark, sf_dir):
    from geomlake.operators.signal import fisher_z

    r = _seeded(spark, sf_dir).groupBy("unit", "run").agg(F.coalesce(F.corr("value", "seed"), F.lit(0.0)).alias("r"))
    return r.groupBy("unit").agg(r6(F.tanh(F.avg(fisher_z(F.col("r"))))).alias("r"))


@query("G22", f"WITH {T.SQL_S}, w AS (SELECT run, k, max(value) FILTER (unit = 'error') AS e, max(value) FILTER (unit = 'purchase') AS p FROM s GROUP BY ALL), c AS (SELECT unit, corr(value, e) AS xy, corr(value, p) AS xz, corr(e, p) AS yz FROM s JOIN w USING (run, k) WHERE unit NOT IN ('error', 'purchase') GROUP BY unit) SELECT unit, round(xy, 6) + 0.0 AS r, round({_PARTIAL.format(xy='xy', xz='xz', yz='yz')}, 6) + 0.0 AS partial FROM c")
def partial_connectivity(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    w = s.groupBy("run", "k").agg(*[F.max(F.when(F.col("unit") == u, F.col("value"))).alias(u[0]) for u in ("error", "purchase")])
    rows = s.where(~F.col("unit").isin("error", "purchase")).join(w, ["run", "k"])
    return rows.groupBy("unit").agg(r6(F.corr("value", "e")).alias("r"), r6(ranks.partial(F.corr("value", "e"), F.corr("value", "p"), F.corr("e", "p"))).alias("partial"))


@query("G23", f"WITH {T.SQL_E}, c AS (SELECT d, corr(x, label) AS a, corr(x, vec_id % 17) AS v, corr(x, vec_id % 5) AS p FROM e GROUP BY d) SELECT round(corr(a - v, p - a), 6) AS r, round(stddev_samp(a - v), 6) AS spread FROM c")
def channel_axes(spark, sf_dir):
    c = T.long_patterns(spark, sf_dir).groupBy("d").agg(F.corr("x", "label").alias("a"), F.corr("x", F.col("vec_id") % 17).alias("v"), F.corr("x", F.col("vec_id") % 5).alias("p"))
    return c.agg(F.round(F.corr(F.col("a") - F.col("v"), F.col("p") - F.col("a")), 6).alias("r"), F.round(F.stddev_samp(F.col("a") - F.col("v")), 6).alias("spread"))


SQL_MAPS = T.SQL_SUB + ", mp AS (SELECT subject, max(value) FILTER (unit = 'AF') AS av, max(value) FILTER (unit = 'NF') AS a, max(value) FILTER (unit = 'RF') AS v FROM (SELECT subject, unit, avg(value) AS value FROM sub GROUP BY ALL) GROUP BY subject)"


def _maps(spark, sf_dir):
    s = T.subjects(spark, sf_dir).groupBy("subject", "unit").agg(F.avg("value").alias("value"))
    return s.groupBy("subject").agg(*[F.max(F.when(F.col("unit") == u, F.col("value"))).alias(n) for u, n in (("AF", "av"), ("NF", "a"), ("RF", "v"))])


@query("G24", f"WITH {SQL_MAPS} SELECT subject, coalesce(av > 0 AND av > a AND av > v, false) AS conjunction, round(av - (a + v), 6) + 0.0 AS super, round(av - greatest(a, v), 6) + 0.0 AS max_uni FROM mp")
def av_derived(spark, sf_dir):
    av, a, v = F.col("av"), F.col("a"), F.col("v")
    return _maps(spark, sf_dir).select("subject", F.coalesce((av > 0) & (av > a) & (av > v), F.lit(False)).alias("conjunction"), r6(av - (a + v)).alias("super"), r6(F.when(a.isNotNull() | v.isNotNull(), av - F.greatest(a, v))).alias("max_uni"))


@query("G25", f"WITH {SQL_MAPS} SELECT CASE WHEN av - greatest(a, v) > 0 THEN 'present' WHEN av IS NULL OR (a IS NULL AND v IS NULL) THEN 'missing' ELSE 'absent' END AS presence, count(*) AS n, round(avg(av - greatest(a, v)), 6) + 0.0 AS m FROM mp GROUP BY 1")
def modality_presence(spark, sf_dir):
    diff = F.col("av") - F.greatest("a", "v")
    kind = F.when(diff > 0, "present").when(F.col("av").isNull() | (F.col("a").isNull() & F.col("v").isNull()), "missing").otherwise("absent")
    return _maps(spark, sf_dir).groupBy(kind.alias("presence")).agg(F.count("*").alias("n"), r6(F.avg(diff)).alias("m"))


@query("G26 K06 R07", f"WITH {T.SQL_SUB}, z AS (SELECT subject, unit, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM (SELECT subject, unit, avg(value) AS value FROM sub GROUP BY ALL) WINDOW w AS (PARTITION BY unit)), m AS (SELECT subject, avg(z) AS m, count(*) FILTER (z > 0) AS positive FROM z GROUP BY subject) SELECT subject, round(m, 6) + 0.0 AS m, positive, CAST(row_number() OVER (ORDER BY m DESC, subject) AS INT) AS rank FROM m")
def convergence(spark, sf_dir):
    w = Q.Window.partitionBy("unit")
    s = T.subjects(spark, sf_dir).groupBy("subject", "unit").agg(F.avg("value").alias("value"))
    z = s.select("subject", ((F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)).alias("z"))
    m = z.groupBy("subject").agg(F.avg("z").alias("m"), F.count_if(F.col("z") > 0).alias("positive"))
    return aggregates.global_rank(m, F.desc("m"), F.col("subject")).select("subject", r6("m").alias("m"), "positive", "rank")
