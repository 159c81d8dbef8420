"""Queries of statistical inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geomlake.functions import special
from geomlake.functions import vectors as V
from geomlake.functions.vectors import r6
from geomlake.operators import inference as H
from geomlake.operators import ranking
from geomlake.plans import q_geometry as Q2
from geomlake.plans import q_pairs as Q
from geomlake.plans.registry import query
from geomlake.sources import tables as T

#: Per subject and unit: the mean over blocks less the subject's mean.
SQL_D = T.SQL_SUB + ", mu AS (SELECT subject, unit, avg(value) AS v FROM sub GROUP BY ALL), df AS (SELECT subject, unit, v - avg(v) OVER (PARTITION BY subject) AS d FROM mu)"


def _effects(spark, sf_dir):
    m = T.subjects(spark, sf_dir).groupBy("subject", "unit").agg(F.avg("value").alias("v"))
    return m.select("subject", "unit", (F.col("v") - F.avg("v").over(Window.partitionBy("subject"))).alias("d"))


@query("H01", f"WITH {SQL_D} SELECT unit, count(*) AS n, round(avg(d), 6) + 0.0 AS m, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) + 0.0 AS t, count(*) - 1 AS df FROM df GROUP BY unit")
def ttest_one_sample(spark, sf_dir):
    return H.t_one_sample(_effects(spark, sf_dir), "d", "unit").select("unit", "n", r6("m").alias("m"), (F.round("t", 5) + 0.0).alias("t"), "df")


@query("H01 A12")
def ttest_p_values(spark, sf_dir):
    return H.one_tailed(H.t_one_sample(_effects(spark, sf_dir), "d", "unit"))


@query("H09 G07", f"WITH {Q2.SQL_BR}, c AS (SELECT label, corr(rd, rda) AS r, count(*) AS n FROM br GROUP BY label) SELECT label, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t, n - 2 AS df FROM c")
def corr_to_t(spark, sf_dir):
    c = Q2.correlated(spark, sf_dir, ("d", "da")).withColumnRenamed("d_da", "r")
    return c.select("label", F.round(H.correlation_t(F.col("r"), F.col("n")), 5).alias("t"), (F.col("n") - 2).alias("df"))


@query("H14", f"WITH {T.SQL_E}, w AS (SELECT c.label, d, avg(x) FILTER (e.label = c.label) AS ma, avg(x) FILTER (e.label <> c.label) AS mb, var_samp(x) FILTER (e.label = c.label) / count(*) FILTER (e.label = c.label) AS va, var_samp(x) FILTER (e.label <> c.label) / count(*) FILTER (e.label <> c.label) AS vb FROM e, (SELECT DISTINCT label FROM v) c GROUP BY ALL), t AS (SELECT label, (ma - mb) / sqrt(va + vb) AS t FROM w) SELECT label, round(median(t), 6) + 0.0 AS score, round(max(t), 6) AS best FROM t GROUP BY label".replace("WITH e", f"WITH {T.SQL_V}, e"))
def welch_median(spark, sf_dir):
    t = H.welch_rest(T.long_patterns(spark, sf_dir), "x", "label", "d")
    return t.groupBy("label").agg(r6(F.median("t")).alias("score"), F.round(F.max("t"), 6).alias("best"))


_P = "round(exp(-abs(avg(d) / (stddev_samp(d) / sqrt(count(*))))), 12)"


@query("H07", f"WITH {SQL_D}, p AS (SELECT subject % 10 AS family, unit, {_P} AS p FROM df GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, unit) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT family, unit, round(least(1, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r")
def bh_fdr(spark, sf_dir):
    t = F.abs(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*"))))
    p = _effects(spark, sf_dir).groupBy((F.col("subject") % 10).alias("family"), "unit").agg(F.round(F.exp(-t), 12).alias("p"))
    return H.fdr(p, "p", "family", ties=("unit",)).select("family", "unit", F.round("q", 9).alias("q"))


_NULLS = f"WITH {SQL_D}, sg AS (SELECT unnest(range(200))::INT AS perm), nl AS (SELECT perm, unit, avg(d * (1 - 2 * (((perm + 1) * 7919 + subject * 104729) % 1000003 // 8 % 2))) AS v FROM df, sg GROUP BY ALL), ob AS (SELECT unit, avg(d) AS v FROM df GROUP BY unit)"


def _flipped(spark, sf_dir, n_perm=200):
    sums = H.signed_sums(_effects(spark, sf_dir).withColumn("x", F.array("d")), "unit", "subject", "x", n_perm)
    v = sums.select("unit", "perm", (F.col("s") / F.col("n")).alias("v"))
    return v.where("perm = -1").select("unit", "v"), v.where("perm >= 0")


@query("H04", _NULLS + " SELECT ob.unit, round(any_value(ob.v), 6) + 0.0 AS v, round((count(*) FILTER (nl.v >= ob.v - 1e-12) + 1) / 201.0, 6) AS p FROM ob JOIN nl USING (unit) GROUP BY ob.unit")
def signflip(spark, sf_dir):
    seen, null = _flipped(spark, sf_dir)
    met = null.withColumnRenamed("v", "null").join(seen, "unit")
    return met.groupBy("unit").agg(r6(F.first("v")).alias("v"), F.round((F.count_if(F.col("null") >= F.col("v") - 1e-12) + 1) / 201.0, 6).alias("p"))


@query("H08", _NULLS + ", mx AS (SELECT perm, max(v) AS top FROM nl GROUP BY perm), cr AS (SELECT top AS critical FROM (SELECT top, row_number() OVER (ORDER BY top) AS rk FROM mx) WHERE rk = 200 + 1 - floor(0.05 * 201)::INT) SELECT unit, round((count(*) FILTER (top >= v - 1e-12) + 1) / 201.0, 6) AS p, round(any_value(critical), 6) AS critical FROM ob, mx, cr GROUP BY unit")
def maxstat_fwe(spark, sf_dir):
    seen, null = _flipped(spark, sf_dir)
    return H.max_stat(null, seen, "v", 0.05).select("unit", F.round("p", 6).alias("p"), F.round("critical", 6).alias("critical"))


@query("H02 H03 J11 R08 G29", f"WITH {Q2.SQL_BR}, {Q.SQL_PERM}, n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY i, j) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, rd, rdj FROM br), o AS (SELECT label, corr(rd, rdj) AS r FROM br GROUP BY label), q AS (SELECT x.label, p, corr(x.rd, y.rdj) AS r FROM n x JOIN pm ON true JOIN n y ON x.label = y.label AND y.k = (x.k + off) % x.n GROUP BY ALL) SELECT label, round(any_value(o.r), 6) + 0.0 AS r, round((count(*) FILTER (q.r >= o.r - 1e-12) + 1) / 21.0, 6) AS p, round(max(q.r), 6) + 0.0 AS top FROM q JOIN o USING (label) GROUP BY label")
def perm_shift(spark, sf_dir):
    shifts = Q.shifts(spark, 20, 64)
    # SQL moves the second of two ranks on by the offset.
    rows = ranking.shifted(T.patterns(spark, sf_dir), Q2.RDMS["d"], {"dj": Q2.RDMS["dj"]}, [0, *sorted({r["off"] for r in shifts.collect()})])  # 20 shifts
    seen = F.max(F.when(F.col("off") == 0, F.col("r_dj"))).over(Window.partitionBy("label"))
    met = rows.withColumn("r", seen).join(F.broadcast(shifts), "off").withColumnRenamed("r_dj", "null")
    return met.groupBy("label").agg(r6(F.first("r")).alias("r"), F.round((F.count_if(F.col("null") >= F.col("r") - 1e-12) + 1) / 21.0, 6).alias("p"), r6(F.max("null")).alias("top"))


@query("H12 R08 E04", f"WITH {T.SQL_S}, {Q.SQL_PERM}, g AS (SELECT run, k, unit, avg(value) AS v FROM s GROUP BY ALL), rn AS (SELECT run, max(k) + 1 AS n FROM g GROUP BY run), m AS (SELECT p, unit, ((k + off * 2) % n) // 24 % 3 AS state, avg(v) AS m FROM g JOIN rn USING (run), pm GROUP BY ALL), o AS (SELECT unit, k // 24 % 3 AS state, avg(v) AS m FROM g GROUP BY ALL) SELECT unit, CAST(state AS INT) AS state, round(any_value(o.m), 6) AS m, round(greatest(count(*) FILTER (m.m >= o.m - 1e-12) / 20.0, 1 / 20.0), 6) AS p FROM m JOIN o USING (unit, state) GROUP BY ALL")
def block_perm(spark, sf_dir):
    g = T.signal(spark, sf_dir).select("run", "k", "unit", F.col("value").alias("v")).withColumn("n", F.max("k").over(Window.partitionBy("run")) + 1)
    state = lambda k: (F.floor(k / 24) % 3).cast("int")
    null = g.join(F.broadcast(Q.shifts(spark, 20, 64))).groupBy("p", "unit", state((F.col("k") + F.col("off") * 2) % F.col("n")).alias("state")).agg(F.avg("v").alias("null"))
    seen = g.groupBy("unit", state(F.col("k")).alias("state")).agg(F.avg("v").alias("m"))
    return null.join(seen, ["unit", "state"]).groupBy("unit", "state").agg(F.round(F.first("m"), 6).alias("m"), F.round(F.greatest(F.count_if(F.col("null") >= F.col("m") - 1e-12) / 20.0, F.lit(1 / 20.0)), 6).alias("p"))


#: Draw j of resample b among n items, by an arithmetic hash; 60 resamples.
_DRAW = "((x * x % 1000003) * x % 1000003) % n"


def _drawn(items: str, of: str) -> str:
    """b, item, w: how often resample b draws each item of a table."""
    return f"{items}_i AS (SELECT {of} AS item, row_number() OVER (ORDER BY {of}) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT {of} FROM sub)), {items} AS (SELECT b, i.item, count(*) AS w FROM (SELECT b, {_DRAW} AS pos FROM (SELECT b, n, ((b + 1) * 7919 + j * 104729 + 17) % 1000003 AS x FROM {items}_i, bt)) JOIN {items}_i i ON i.j = pos GROUP BY ALL)"


@query("H05", f"WITH {T.SQL_SUB}, bt AS (SELECT unnest(range(60)) AS b), {_drawn('ds', 'subject')}, {_drawn('db', 'block')}, sb AS (SELECT unit, b, sum(v * w) / sum(w) AS m FROM (SELECT subject, unit, avg(value) AS v FROM sub GROUP BY ALL) JOIN ds ON subject = item GROUP BY ALL), bb AS (SELECT unit, b, sum(v * w) / sum(w) AS m FROM (SELECT block, unit, avg(value) AS v FROM sub GROUP BY ALL) JOIN db ON block = item GROUP BY ALL), bo AS (SELECT unit, ds.b, sum(value * ds.w * db.w) / sum(ds.w * db.w) AS m FROM sub JOIN ds ON subject = ds.item JOIN db ON block = db.item AND db.b = ds.b GROUP BY ALL), vs AS (SELECT unit, var_samp(m) AS v FROM sb GROUP BY unit), vb AS (SELECT unit, var_samp(m) AS v FROM bb GROUP BY unit), vo AS (SELECT unit, var_samp(m) AS v FROM bo GROUP BY unit) SELECT unit, round(least(greatest(2 * (vs.v + vb.v) - vo.v, greatest(vs.v, vb.v)), greatest(vo.v, vs.v, vb.v)), 6) + 0.0 AS corrected, round(vo.v, 6) AS both_ways FROM vs JOIN vb USING (unit) JOIN vo USING (unit)")
def bootstrap_c2f(spark, sf_dir):
    s = T.subjects(spark, sf_dir)
    subjects, blocks = (H.resamples(s, of, 60) for of in ("subject", "block"))
    subject = H.bootstrap_variance(s.groupBy("subject", "unit").agg(F.avg("value").alias("v")).join(subjects, "subject"), "v", F.col("w_subject"), "unit").withColumnRenamed("var", "vs")
    block = H.bootstrap_variance(s.groupBy("block", "unit").agg(F.avg("value").alias("v")).join(blocks, "block"), "v", F.col("w_block"), "unit").withColumnRenamed("var", "vb")
    both = H.bootstrap_variance(s.join(subjects, "subject").join(blocks, ["block", "boot"]), "value", F.col("w_subject") * F.col("w_block"), "unit").withColumnRenamed("var", "vo")
    lower = F.greatest("vs", "vb")
    c = F.least(F.greatest(2 * (F.col("vs") + F.col("vb")) - F.col("vo"), lower), F.greatest(F.col("vo"), lower))
    return subject.join(block, "unit").join(both, "unit").select("unit", r6(c).alias("corrected"), F.round("vo", 6).alias("both_ways"))


@query("H06", f"WITH {T.SQL_S}, n AS (SELECT run, max(k) + 1 AS n FROM s GROUP BY run), bt AS (SELECT unnest(range(40)) AS b), ix AS (SELECT b, run, j, ((b * 7919 + (j // 6) * 104729 + run * 31) % 1000003 % n + j % 6) % n AS k FROM n, bt, LATERAL (SELECT unnest(range(n)) AS j)), m AS (SELECT unit, b, avg(value) AS m FROM ix JOIN s ON s.run = ix.run AND s.k = ix.k GROUP BY ALL) SELECT unit, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY unit")
def block_bootstrap_ci(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    n = s.groupBy("run").agg((F.max("k") + 1).alias("n"))
    ix = n.join(F.broadcast(spark.range(40).withColumnRenamed("id", "b"))).select("b", "run", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    start = (F.col("b") * 7919 + F.floor(F.col("j") / 6) * 104_729 + F.col("run") * 31) % 1_000_003 % F.col("n")
    drawn = ix.select("b", "run", ((start + F.col("j") % 6) % F.col("n")).cast("int").alias("k")).groupBy("b", "run", "k").count()
    m = drawn.join(s, ["run", "k"]).groupBy("unit", "b").agg((F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("m"))
    return m.groupBy("unit").agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


_TABLE2 = "SELECT source, count(*) FILTER (quality = 0 AND lang = 'en') AS a, count(*) FILTER (quality = 0 AND lang <> 'en') AS b, count(*) FILTER (quality = 1 AND lang = 'en') AS c, count(*) FILTER (quality = 1 AND lang <> 'en') AS d FROM documents JOIN labels USING (doc_id) GROUP BY source"


def _two_by_two(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(T.read(spark, sf_dir, "labels"), "doc_id")
    bad, en = F.col("quality") == 0, F.col("lang") == "en"
    return d.groupBy("source").agg(F.count_if(bad & en).alias("a"), F.count_if(bad & ~en).alias("b"), F.count_if(~bad & en).alias("c"), F.count_if(~bad & ~en).alias("d"))


@query("H15", f"WITH t AS ({_TABLE2}) SELECT *, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds, round(a / greatest(a + b, 1), 6) AS purity FROM t")
def fisher_enrichment(spark, sf_dir):
    t, c = _two_by_two(spark, sf_dir), F.col
    return t.select("*", F.round((c("a") + 0.5) * (c("d") + 0.5) / ((c("b") + 0.5) * (c("c") + 0.5)), 6).alias("odds"), F.round(c("a") / F.greatest(c("a") + c("b"), F.lit(1)), 6).alias("purity"))


@query("H15")
def fisher_p_values(spark, sf_dir):
    return _two_by_two(spark, sf_dir).select("source", special.fisher_p(*map(F.col, "abcd")).alias("p"))


@query("H10 J12", f"WITH {Q.SQL_GRID}, {T.SQL_E}, f AS (SELECT label, row, col, avg(x) AS v FROM e JOIN g USING (d) GROUP BY ALL), sp AS (SELECT unnest(range(64))::INT AS s), r AS (SELECT a.label, s, sum(a.v * b.v) AS c FROM f a JOIN sp ON true JOIN f b ON b.label = (a.label + 1) % 10 AND b.row = (a.row + s // 8) % 8 AND b.col = (a.col + s % 8) % 8 GROUP BY ALL) SELECT label, round(max(c) FILTER (s = 0), 6) + 0.0 AS seen, round(count(*) FILTER (abs(c) >= (SELECT abs(q.c) FROM r q WHERE q.label = r.label AND q.s = 0) - 1e-12) / 64.0, 6) AS p FROM r GROUP BY label")
def spin_test(spark, sf_dir):
    f = T.long_patterns(spark, sf_dir).join(F.broadcast(Q.grid(spark)), "d").groupBy("label", "row", "col").agg(F.avg("x").alias("v"))
    turned = f.join(F.broadcast(spark.range(64).select(F.col("id").cast("int").alias("s"))))
    turned = turned.select("label", "s", F.col("v").alias("va"), ((F.col("label") + 1) % 10).alias("other"), ((F.col("row") + F.floor(F.col("s") / 8)) % 8).cast("int").alias("row"), ((F.col("col") + F.col("s") % 8) % 8).cast("int").alias("col"))
    r = turned.join(f.withColumnRenamed("label", "other"), ["other", "row", "col"]).groupBy("label", "s").agg(F.sum(F.col("va") * F.col("v")).alias("c"))
    seen = F.max(F.when(F.col("s") == 0, F.col("c"))).over(Window.partitionBy("label"))
    return r.withColumn("seen", seen).groupBy("label").agg(r6(F.first("seen")).alias("seen"), F.round(F.count_if(F.abs("c") >= F.abs("seen") - 1e-12) / 64.0, 6).alias("p"))


@query("H13 H01 J09", f"WITH {T.SQL_SUB}, m AS (SELECT subject, block, max(value) FILTER (unit = 'AF') AS av, max(value) FILTER (unit = 'NF') AS a, max(value) FILTER (unit = 'RF') AS v FROM sub GROUP BY ALL), d AS (SELECT block, av - greatest(a, v) AS d FROM m WHERE av IS NOT NULL AND a IS NOT NULL AND v IS NOT NULL) SELECT block, count(*) AS n, round(avg(d), 6) + 0.0 AS m, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) + 0.0 AS t FROM d GROUP BY block")
def max_uni_group(spark, sf_dir):
    s = T.subjects(spark, sf_dir)
    m = s.groupBy("subject", "block").agg(*[F.max(F.when(F.col("unit") == u, F.col("value"))).alias(n) for u, n in (("AF", "av"), ("NF", "a"), ("RF", "v"))]).dropna()
    t = H.t_one_sample(m.withColumn("d", F.col("av") - F.greatest("a", "v")), "d", "block")
    return t.select("block", "n", r6("m").alias("m"), (F.round("t", 5) + 0.0).alias("t"))


@query("H16 E16", f"WITH {T.SQL_SUB}, sp AS (SELECT unnest(range(10))::INT AS split), h AS (SELECT split, unit, block, (((split + 1) * 7919 + subject * 104729) % 1000003 // 8) % 2 AS half, avg(value) AS v FROM sub, sp GROUP BY ALL), w AS (SELECT split, unit, block, max(v) FILTER (half = 0) AS a, max(v) FILTER (half = 1) AS b FROM h GROUP BY ALL) SELECT split, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM w GROUP BY split")
def split_half(spark, sf_dir):
    half = F.floor(((F.col("split") + 1) * 7919 + F.col("subject") * 104_729) % 1_000_003 / 8) % 2
    h = T.subjects(spark, sf_dir).join(F.broadcast(spark.range(10).select(F.col("id").cast("int").alias("split")))).withColumn("half", half)
    w = h.groupBy("split", "unit", "block").agg(F.avg(F.when(F.col("half") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("b"))
    return w.groupBy("split").agg(r6(F.corr("a", "b")).alias("r"), F.count("*").alias("n"))


@query("H17", f"WITH {T.SQL_V}, l AS (SELECT label, vec_id, x, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM v) SELECT label, count(*) AS n, count(*) FILTER (list_inner_product(x, x) = 0) AS zero_rows, count(*) FILTER (len(list_filter(x, lambda q: NOT isfinite(q))) > 0) AS bad_rows, round(avg(list_cosine_similarity(x, y)), 6) + 0.0 AS adjacent FROM l GROUP BY label")
def embedding_qa(spark, sf_dir):
    l = T.patterns(spark, sf_dir).withColumn("y", F.lead("x").over(Window.partitionBy("label").orderBy("vec_id")))
    cosine = V.dot("x", "y") / F.sqrt(V.dot("x", "x") * V.dot("y", "y"))
    bad = F.exists("x", lambda q: F.isnan(q) | (F.abs(q) == float("inf")))
    return l.groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.dot("x", "x") == 0).alias("zero_rows"), F.count_if(bad).alias("bad_rows"), r6(F.avg(cosine)).alias("adjacent"))
