"""Queries of pair joins, ranks and neighbour lookups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from geomlake.functions import vectors as V
from geomlake.functions.vectors import r6
from geomlake.operators import blocked, fused, ranking
from geomlake.operators import pairs as P
from geomlake.plans.registry import query
from geomlake.sources import tables as T

SQL_P = T.SQL_C + """,
 p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, 1 - list_inner_product(a.z, b.z) AS d_corr, list_distance(a.x, b.x) ** 2 AS d_euc FROM c a JOIN c b ON a.label = b.label AND a.vec_id > b.vec_id)"""
SQL_RANK = """r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY d_corr) + (count(*) OVER (PARTITION BY label, d_corr) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY label ORDER BY d_euc) + (count(*) OVER (PARTITION BY label, d_euc) - 1) / 2.0 AS rb FROM p)"""
SQL_Q = T.SQL_C + ", q AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS la, b.label AS lb, 1 - list_inner_product(a.z, b.z) AS d FROM c a JOIN c b ON a.vec_id > b.vec_id)"


TWO = {"d_corr": blocked.correlation, "d_euc": blocked.squared}


def within_labels(spark, sf_dir):
    return blocked.within(T.patterns(spark, sf_dir), TWO)


def all_pairs(spark, sf_dir):
    return blocked.pairs(T.patterns(spark, sf_dir))


@query("S07 J01 G01 G02 R01 G03 A10", f"WITH {SQL_P}, {SQL_RANK} SELECT label, count(*) AS n_pairs, round(avg(d_corr), 6) AS mean_d, round(corr(ra, rb), 6) AS rho FROM r GROUP BY label")
def rdm_label_summary(spark, sf_dir):
    found = ranking.correlations(T.patterns(spark, sf_dir), TWO, [("d_corr", "d_euc")])
    return found.select("label", F.col("n").alias("n_pairs"), F.round("mean_d_corr", 6).alias("mean_d"), F.round("d_corr_d_euc", 6).alias("rho"))


@query("J01 G01", f"WITH {SQL_Q} SELECT la = lb AS same, count(*) AS n, round(avg(d), 6) AS m, round(min(d), 6) AS low, round(max(d), 6) AS high FROM q GROUP BY 1")
def rdm_all_pairs(spark, sf_dir):
    return all_pairs(spark, sf_dir).groupBy((F.col("la") == F.col("lb")).alias("same")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("m"), F.round(F.min("d"), 6).alias("low"), F.round(F.max("d"), 6).alias("high"))


@query("J04", f"WITH {SQL_P} SELECT label, i, j, round(d_corr, 6) + 0.0 AS d FROM p")
def pairs_within(spark, sf_dir):
    return within_labels(spark, sf_dir).select("label", "i", "j", r6("d_corr").alias("d"))


@query("J04", f"WITH {T.SQL_C} SELECT a.label AS ga, b.label AS gb, count(*) AS n, round(avg(1 - list_inner_product(a.z, b.z)), 6) AS d FROM c a JOIN c b ON a.label > b.label GROUP BY ALL")
def pairs_cross(spark, sf_dir):
    rows = all_pairs(spark, sf_dir).where("la <> lb")
    return rows.groupBy(F.greatest("la", "lb").alias("ga"), F.least("la", "lb").alias("gb")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("d"))


@query("J03 J04", f"WITH {SQL_Q} SELECT i % 10 AS tenth, count(CASE WHEN la <> lb THEN d END) AS kept, count(CASE WHEN la = lb THEN d END) AS masked FROM q GROUP BY 1")
def masked_rdm(spark, sf_dir):
    q = all_pairs(spark, sf_dir)
    return q.groupBy((F.col("i") % 10).alias("tenth")).agg(F.count(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("kept"), F.count(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("masked"))


@query("G03", f"WITH {SQL_P} SELECT label, round(corr(d_corr, d_euc), 6) AS r FROM p GROUP BY label")
def rdm_pearson(spark, sf_dir):
    return within_labels(spark, sf_dir).groupBy("label").agg(F.round(F.corr("d_corr", "d_euc"), 6).alias("r"))


@query("G03 R01 J03", f"WITH {T.SQL_V}, a AS (SELECT vec_id, label, x[1:32] AS x FROM v), b AS (SELECT vec_id, label, x[33:64] AS x FROM v), pa AS (SELECT s.label, s.vec_id AS i, t.vec_id AS j, list_distance(s.x, t.x) ** 2 AS d FROM a s JOIN a t ON s.label = t.label AND s.vec_id > t.vec_id), pb AS (SELECT s.label, s.vec_id AS i, t.vec_id AS j, list_distance(s.x, t.x) ** 2 AS d FROM b s JOIN b t ON s.label = t.label AND s.vec_id > t.vec_id), r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY pa.d) AS ra, rank() OVER (PARTITION BY label ORDER BY pb.d) AS rb FROM pa JOIN pb USING (label, i, j)) SELECT label, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY label")
def rdm_spearman(spark, sf_dir):
    halves = {"da": blocked.band(blocked.squared, 1, 32), "db": blocked.band(blocked.squared, 33, 64)}
    return ranking.correlations(T.patterns(spark, sf_dir), halves, [("da", "db")], method="min").select("label", "n", F.round("da_db", 6).alias("rho"))


@query("G01", f"WITH {T.SQL_V} SELECT a.label, round(avg(1 - list_cosine_similarity(a.x, b.x)), 6) AS d, count(*) AS n FROM v a JOIN v b ON a.label = b.label AND a.vec_id > b.vec_id GROUP BY a.label")
def rdm_cosine(spark, sf_dir):
    rows = blocked.within(T.patterns(spark, sf_dir), {"d": blocked.cosine})
    return rows.groupBy("label").agg(F.round(F.avg("d"), 6).alias("d"), F.count("*").alias("n"))


@query("G04", f"WITH {SQL_P}, t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY i, j) AS k, d_corr, d_euc FROM p) SELECT a.label, round(sum(sign(a.d_corr - b.d_corr) * sign(a.d_euc - b.d_euc)) / sqrt(sum(abs(sign(a.d_corr - b.d_corr))) * sum(abs(sign(a.d_euc - b.d_euc)))), 6) AS tau FROM t a JOIN t b ON a.label = b.label AND a.k > b.k GROUP BY a.label")
def rdm_kendall(spark, sf_dir):
    return ranking.kendall(T.patterns(spark, sf_dir), *TWO.values()).select("label", F.round("tau", 6).alias("tau"))


@query("G06", f"WITH {SQL_P}, {SQL_RANK}, g AS (SELECT label, corr(ra, rb) AS rho FROM r GROUP BY label) SELECT label % 2 AS half, round(avg(rho), 6) AS rho, count(*) AS n FROM g GROUP BY 1")
def grouped_rsa(spark, sf_dir):
    rho = ranking.correlations(T.patterns(spark, sf_dir), TWO, [("d_corr", "d_euc")])
    return rho.groupBy((F.col("label") % 2).alias("half")).agg(F.round(F.avg("d_corr_d_euc"), 6).alias("rho"), F.count("*").alias("n"))


@query("R02", f"WITH {SQL_P} SELECT label, i, j, CAST(row_number() OVER (PARTITION BY label ORDER BY d_corr, i, j) - 1 AS INT) AS rk FROM p")
def ordinal_rank(spark, sf_dir):
    return ranking.numbered(T.patterns(spark, sf_dir), fused.correlation, fused.unit).select("label", "i", "j", F.col("rk").cast("int").alias("rk"))


@query("J05 J06 R06", f"WITH {SQL_Q}, b AS (SELECT i, j, d FROM q UNION ALL SELECT j, i, d FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM b) SELECT i, j, CAST(rk AS INT) AS rk, round(d, 6) AS d FROM k WHERE rk <= 5")
def knn_topk(spark, sf_dir):
    return blocked.nearest(T.patterns(spark, sf_dir), 5).select("i", "j", "rk", F.round("d", 6).alias("d"))


SQL_GRID = "g AS (SELECT u.d AS d, u.d // 8 AS row, u.d % 8 AS col FROM (SELECT unnest(range(64))::INT AS d) u), gn AS (SELECT a.d AS centre, b.d AS nbr, row_number() OVER (PARTITION BY a.d ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.d) AS rk FROM g a JOIN g b ON a.d <> b.d)"


def grid(spark):
    """The 64 features as an 8 by 8 sheet: d, row, col."""
    return spark.range(64).select(F.col("id").cast("int").alias("d"), (F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"))


def grid_neighbours(spark, k: int):
    """centre, nbr, rk: the k nearest places of the sheet, itself left out; 64 places by construction."""
    g = grid(spark)
    a, b = (g.select(F.struct("d", "row", "col").alias(n), F.lit(0).alias("one")) for n in "ab")
    met = a.join(F.broadcast(b), "one").where("a.d <> b.d").select(F.col("a.d").alias("centre"), F.col("b.d").alias("nbr"), ((F.col("a.row") - F.col("b.row")) ** 2 + (F.col("a.col") - F.col("b.col")) ** 2).alias("dist"))
    return P.nearest(met, "centre", "dist", "nbr", k).select("centre", "nbr", "rk")


@query("J06 A17", f"WITH {SQL_GRID} SELECT centre, nbr, CAST(rk AS INT) AS rk FROM gn WHERE rk <= 8")
def knn_grid(spark, sf_dir):
    return grid_neighbours(spark, 8)


@query("A17", f"WITH {SQL_GRID} SELECT d, row, col, CASE WHEN row < 4 AND col < 4 THEN 'nw' WHEN row < 4 THEN 'ne' WHEN col < 4 THEN 'sw' ELSE 'se' END AS tower FROM g")
def grid_coords(spark, sf_dir):
    north, west = F.col("row") < 4, F.col("col") < 4
    return grid(spark).select("d", "row", "col", F.when(north & west, "nw").when(north, "ne").when(west, "sw").otherwise("se").alias("tower"))


@query("J02 G21", f"WITH {SQL_GRID}, {T.SQL_E} SELECT label, centre, round(avg(x), 6) + 0.0 AS m FROM e JOIN gn ON e.d = nbr WHERE rk <= 4 GROUP BY ALL")
def neighbour_gather(spark, sf_dir):
    rows = T.long_patterns(spark, sf_dir).join(F.broadcast(grid_neighbours(spark, 4)), F.col("d") == F.col("nbr"))
    return rows.groupBy("label", "centre").agg(r6(F.avg("x")).alias("m"))


def arithmetic_key(a, b, seed: int, prime: int = 1_000_003):
    """A reproducible order without random numbers: integers of both engines."""
    return (a * 7919 + b * 104_729 + seed) % prime


@query("J08", f"WITH {T.SQL_V}, r AS (SELECT a.label, a.vec_id AS unit, b.vec_id AS mate, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.vec_id * 7919 + b.vec_id * 104729 + 5) % 1000003, b.vec_id) AS rk FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT label, unit, mate, CAST(rk AS INT) AS rk FROM r WHERE rk <= 3")
def random_same_group(spark, sf_dir):
    ids = T.patterns(spark, sf_dir).select("vec_id", "label", F.array(F.col("vec_id").cast("double")).alias("x"))
    found = blocked.nearest_within(ids, 3, lambda a, b: arithmetic_key(a, b[:, 0], 5))
    return found.select("label", F.col("i").alias("unit"), F.col("j").alias("mate"), "rk")


@query("J09 U02", f"WITH {T.SQL_SUB}, a AS (SELECT DISTINCT subject FROM sub WHERE unit = 'AF' AND value > 36), b AS (SELECT DISTINCT subject FROM sub WHERE unit = 'NO' AND value > 36) SELECT subject FROM a INTERSECT SELECT subject FROM b")
def subject_intersection(spark, sf_dir):
    s = T.subjects(spark, sf_dir).where("value > 36")
    return s.where("unit = 'AF'").select("subject").intersect(s.where("unit = 'NO'").select("subject"))


@query("J10 S12", "SELECT r_name, count(*) AS n, round(avg(c_acctbal), 6) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def parcel_join(spark, sf_dir):
    parcels = T.read(spark, sf_dir, "nation").join(F.broadcast(T.read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = T.read(spark, sf_dir, "customer").join(F.broadcast(parcels), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("m"))


SQL_PERM = "pm AS (SELECT p, (1 + (p * 7919 + 104729) % 62)::INT AS off FROM (SELECT unnest(range(20))::INT AS p))"


def shifts(spark, n_perm: int, n: int, run: int = 1):
    """perm p and its non-zero circular offset in [1, n - 1]: few rows by construction."""
    p = F.col("id").cast("int")
    return spark.range(n_perm).select(p.alias("p"), (1 + (p * 7919 + run * 104_729) % (n - 2)).cast("int").alias("off"))


@query("J11 R08", f"WITH {SQL_PERM}, g AS (SELECT unnest(range(64))::INT AS d), m AS (SELECT p, d, (d + 64 - off) % 64 AS sigma FROM g, pm), q AS (SELECT a.p, a.d AS i, b.d AS j, greatest(a.sigma, b.sigma) AS pi, least(a.sigma, b.sigma) AS pj FROM m a JOIN m b ON a.p = b.p AND a.d > b.d) SELECT p, count(*) AS n, count(DISTINCT pi * 64 + pj) AS n_distinct, count(*) FILTER (pi = i AND pj = j) AS fixed FROM q GROUP BY p")
def permuted_pairs(spark, sf_dir):
    places = spark.range(64).select(F.col("id").cast("int").alias("d"))
    moved = places.join(F.broadcast(shifts(spark, 20, 64))).select("p", "d", F.pmod(F.col("d") - F.col("off"), F.lit(64)).alias("sigma"))
    q = P.within(moved, "d", "p").select("p", F.col("a.d").alias("i"), F.col("b.d").alias("j"), F.greatest("a.sigma", "b.sigma").alias("pi"), F.least("a.sigma", "b.sigma").alias("pj"))
    return q.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct(F.col("pi") * 64 + F.col("pj")).alias("n_distinct"), F.count_if((F.col("pi") == F.col("i")) & (F.col("pj") == F.col("j"))).alias("fixed"))


@query("J12 H10", f"WITH {T.SQL_V}, a AS (SELECT vec_id, label, [x[1], x[2], x[3]] AS x, [-x[2], x[1], x[3]] AS y FROM v), q AS (SELECT a.vec_id, b.vec_id AS mate, list_inner_product(a.y, b.x) AS s FROM a JOIN a b ON a.label = b.label) SELECT vec_id, arg_max(mate, (s, -mate)) AS nearest FROM q GROUP BY vec_id")
def rotation_1nn(spark, sf_dir):
    a = T.patterns(spark, sf_dir).select("vec_id", "label", F.slice("x", 1, 3).alias("x"))
    turn = np.array([[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    found = blocked.nearest_within(a, 1, lambda x, y: -(x @ turn) @ y.T, itself=True)
    return found.select(F.col("i").alias("vec_id"), F.col("j").alias("nearest"))


SQL_MATE = f"{T.SQL_V}, o AS (SELECT vec_id, label, x, row_number() OVER (ORDER BY label, (vec_id * 7919 + 11) % 1000003, vec_id) - 1 AS rn, count(*) OVER () AS n FROM v), big AS (SELECT max(k) AS k FROM (SELECT count(*) AS k FROM v GROUP BY label)), mate AS (SELECT o.vec_id, o.label, o.x, m.vec_id AS mate, m.label AS mate_label, m.x AS y FROM o, big JOIN o m ON m.rn = (o.rn - big.k + o.n) % o.n)"


def re_paired(patterns):
    """Each row with a mate of another label: rows in label order, rolled by the largest label's size."""
    n = patterns.groupBy("label").count()
    sizes = n.agg(F.sum("count").alias("n"), F.max("count").alias("k"))
    before = n.select("label", F.coalesce(F.sum("count").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("label").orderBy((F.col("vec_id") * 7919 + 11) % 1_000_003, "vec_id")) - 1
    placed = patterns.withColumn("at", inside).join(F.broadcast(before), "label").join(F.broadcast(sizes)).withColumn("rn", F.col("base") + F.col("at"))  # one row per label, and one in all
    mates = placed.select(F.col("vec_id").alias("mate"), F.col("label").alias("mate_label"), F.col("x").alias("y"), F.col("rn").alias("m"))
    return placed.withColumn("m", F.pmod(F.col("rn") - F.col("k"), F.col("n"))).join(mates, "m").select("vec_id", "label", "x", "mate", "mate_label", "y")


@query("J13", f"WITH {SQL_MATE} SELECT vec_id, mate, label <> mate_label AS differs FROM mate")
def cross_clip_pairing(spark, sf_dir):
    return re_paired(T.patterns(spark, sf_dir)).select("vec_id", "mate", (F.col("label") != F.col("mate_label")).alias("differs"))


@query("G18 J13", f"WITH {SQL_MATE}, t AS (SELECT vec_id, label, x[1:32] AS a, x[33:64] AS b, y[1:32] AS c, y[33:64] AS d FROM mate), w AS (SELECT vec_id, list_transform(range(1, 33), lambda i: (a[i] * b[i] + c[i] * d[i]) - a[i] * d[i] - c[i] * b[i]) AS f FROM t) SELECT vec_id, round(list_sum(f), 6) + 0.0 AS s, round(list_max(f), 6) + 0.0 AS high FROM w")
def factorial_contrast(spark, sf_dir):
    halves = {n: F.slice(c, s, 32) for n, c, s in (("a", "x", 1), ("b", "x", 33), ("c", "y", 1), ("d", "y", 33))}
    rows = re_paired(T.patterns(spark, sf_dir)).select("vec_id", *[v.alias(k) for k, v in halves.items()])
    times = lambda p, q: F.zip_with(p, q, lambda x, y: x * y)
    plus = F.zip_with(times("a", "b"), times("c", "d"), lambda x, y: x + y)
    f = V.minus(V.minus(plus, times("a", "d")), times("c", "b"))
    return rows.select("vec_id", f.alias("f")).select("vec_id", r6(V.total("f")).alias("s"), r6(F.array_max("f")).alias("high"))


@query("J15", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier)) AS only_left, (SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT DISTINCT l_suppkey FROM lineitem)) AS only_right")
def axis_equality(spark, sf_dir):
    a = T.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    b = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full_outer")
    return sides.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


@query("J16", "SELECT p_type, n_parts, coalesce(revenue, 0) AS revenue FROM (SELECT p_type, count(*) AS n_parts FROM part GROUP BY 1) LEFT JOIN (SELECT p_type, round(sum(l_extendedprice), 2) AS revenue FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) USING (p_type)")
def evidence_merge(spark, sf_dir):
    part = T.read(spark, sf_dir, "part").select("p_partkey", "p_type")
    sums = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("s"))
    sums = part.join(sums, "p_partkey").groupBy("p_type").agg(F.round(F.sum("s"), 2).alias("revenue"))
    return part.groupBy("p_type").agg(F.count("*").alias("n_parts")).join(sums, "p_type", "left").fillna({"revenue": 0.0})
