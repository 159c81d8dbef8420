"""Queries of time windows and signal cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geomlake.functions import special
from geomlake.functions.vectors import near6, r6
from geomlake.operators import signal as A
from geomlake.operators import windows as W
from geomlake.plans.registry import query
from geomlake.sources import tables as T

TUMBLE, SLIDE = (5, 5, 3), (6, 2, 2)


def _windows_sql(width: int, stride: int, delay: int) -> str:
    return T.SQL_CLIPS + f""", ro AS (SELECT run, n_tr, coalesce(sum(n_tr) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_tr FROM runs),
 w0 AS (SELECT clips.*, n_tr, CASE WHEN dur >= {width} THEN (dur - {width}) // {stride} + 1 ELSE 0 END AS n, round_even(onset - start_tr + {delay}, 0)::INT AS first FROM clips JOIN ro USING (run)),
 w1 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY run, onset, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w0),
 w2 AS (SELECT *, unnest(range(n))::INT AS w FROM w1 WHERE first >= 0 AND first < n_tr),
 win AS (SELECT video_id, run, w, (first + w * {stride})::INT AS start, (first + w * {stride} + {width})::INT AS stop, (base + w)::INT AS row_idx FROM w2 WHERE first + w * {stride} + {width} <= n_tr)"""


def _windows(spark, sf_dir, setting):
    return W.window_index(T.clips(spark, sf_dir), T.runs(spark, sf_dir), *setting)


@query("W01 W06 R03 S08", f"WITH {_windows_sql(*TUMBLE)} SELECT * FROM win")
def window_index_tumbling(spark, sf_dir):
    return _windows(spark, sf_dir, TUMBLE)


@query("W01", f"WITH {_windows_sql(*SLIDE)} SELECT * FROM win")
def window_index_sliding(spark, sf_dir):
    return _windows(spark, sf_dir, SLIDE)


@query("W06 R03", f"WITH {T.SQL_CLIPS} SELECT run, n_tr, coalesce(sum(n_tr) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_tr FROM runs")
def run_offsets(spark, sf_dir):
    return W.run_offsets(T.runs(spark, sf_dir))


_BIN = f"""WITH {T.SQL_S}, {_windows_sql(*TUMBLE)[len(T.SQL_H) + 2:]},
 b AS (SELECT unit, s.run, video_id, w, avg(value) AS value FROM s JOIN win ON s.run = win.run AND k >= start AND k < stop GROUP BY ALL)"""


@query("W02 A07 J02", _BIN + " SELECT unit, run, video_id, w, round((value - avg(value) OVER g) / stddev_pop(value) OVER g, 6) + 0.0 AS z FROM b WINDOW g AS (PARTITION BY unit, run)")
def binned_zscore(spark, sf_dir):
    rows = W.binned(T.signal(spark, sf_dir), _windows(spark, sf_dir, TUMBLE))
    return W.scaled(rows, "unit", "run").select("unit", "run", "video_id", "w", r6("value").alias("z"))


@query("W02 A07", _BIN + " SELECT unit, run, video_id, w, round(value - avg(value) OVER (PARTITION BY unit, run) + 1.7e-10, 6) + 0.0 AS c FROM b")
def binned_center(spark, sf_dir):
    rows = W.binned(T.signal(spark, sf_dir), _windows(spark, sf_dir, TUMBLE))
    return W.scaled(rows, "unit", "run", how="center").select("unit", "run", "video_id", "w", near6("value").alias("c"))


@query("W03 S07", f"WITH {_windows_sql(*SLIDE)}, {T.SQL_E} SELECT run, d, round(avg(x), 6) + 0.0 AS m, round(stddev_pop(x), 6) AS sd, count(*) AS n FROM win JOIN e ON row_idx = vec_id GROUP BY ALL")
def aligned_embedding_stats(spark, sf_dir):
    rows = _windows(spark, sf_dir, SLIDE).join(T.long_patterns(spark, sf_dir), F.col("row_idx") == F.col("vec_id"))
    return rows.groupBy("run", "d").agg(r6(F.avg("x")).alias("m"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.count("*").alias("n"))


_TEST = "video_id % 5 = 2"


@query("W04 M01", _BIN + f", t AS (SELECT *, {_TEST} AS is_test FROM b) SELECT unit, run, video_id, w, is_test, round(CASE WHEN stddev_pop(value) OVER g > 1e-12 THEN (value - avg(value) OVER g) / stddev_pop(value) OVER g ELSE 0 END, 6) + 0.0 AS z FROM t WINDOW g AS (PARTITION BY unit, run, is_test)")
def split_binned_zscore(spark, sf_dir):
    rows = W.binned(T.signal(spark, sf_dir), _windows(spark, sf_dir, TUMBLE)).withColumn("is_test", F.expr(_TEST))
    return W.scaled(rows, "unit", "run", "is_test", constant=0.0).select("unit", "run", "video_id", "w", "is_test", r6("value").alias("z"))


@query("A08", _BIN + f", t AS (SELECT *, {_TEST} AS is_test FROM b) SELECT unit, run, video_id, w, is_test, round((value - avg(value) FILTER (NOT is_test) OVER g) / stddev_pop(value) FILTER (NOT is_test) OVER g, 6) + 0.0 AS z FROM t WINDOW g AS (PARTITION BY unit, run)")
def leakfree_scaling(spark, sf_dir):
    rows = W.binned(T.signal(spark, sf_dir), _windows(spark, sf_dir, TUMBLE)).withColumn("is_test", F.expr(_TEST))
    g, train = Window.partitionBy("unit", "run"), F.when(~F.col("is_test"), F.col("value"))
    return rows.select("unit", "run", "video_id", "w", "is_test", r6((F.col("value") - F.avg(train).over(g)) / F.stddev_pop(train).over(g)).alias("z"))


@query("W05", f"WITH {_windows_sql(*TUMBLE)}, {T.SQL_H[0:0]}x AS (SELECT run, count(*) AS n_windows, max(stop) AS last FROM win GROUP BY run) SELECT x.run, n_windows, last <= n_tr AS fits, n_windows = (SELECT count(DISTINCT row_idx) FROM win WHERE win.run = x.run) AS aligned FROM x JOIN runs USING (run)")
def window_asserts(spark, sf_dir):
    rows = _windows(spark, sf_dir, TUMBLE).groupBy("run").agg(F.count("*").alias("n_windows"), F.max("stop").alias("last"), F.count_distinct("row_idx").alias("rows"))
    return rows.join(T.runs(spark, sf_dir), "run").select("run", "n_windows", (F.col("last") <= F.col("n_tr")).alias("fits"), (F.col("n_windows") == F.col("rows")).alias("aligned"))


@query("W07", f"WITH {T.SQL_S}, rest AS (SELECT run, (24 * (k // 24) + 2)::INT AS start, (24 * (k // 24) + 6)::INT AS stop FROM s GROUP BY ALL) SELECT unit, run, count(*) AS n, round(avg(value), 6) + 0.0 AS m FROM s WHERE EXISTS (SELECT 1 FROM rest WHERE rest.run = s.run AND k >= start AND k < stop) GROUP BY ALL")
def rest_mask(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    first = 24 * F.floor(F.col("k") / 24) + 2
    rest = s.select("run", first.cast("int").alias("start"), (first + 4).cast("int").alias("stop")).distinct()
    return W.inside(s, rest).groupBy("unit", "run").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("m"))


@query("W08", f"WITH {T.SQL_S}, p AS (SELECT event_id, unit, (tr // {T.RUN_TR}) AS run, tr % {T.RUN_TR} + 5 AS a FROM h WHERE value > 25), r AS (SELECT run, max(k) + 1 AS n FROM s GROUP BY run) SELECT event_id, round(coalesce(avg(value), 0), 6) + 0.0 AS beta, count(value) AS n FROM p JOIN r USING (run) LEFT JOIN s ON s.unit = p.unit AND s.run = p.run AND k >= a AND k < least(a + 3, r.n) GROUP BY event_id")
def interval_beta(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    onset = F.col("tr") % T.RUN_TR + 5
    picked = T.hours(spark, sf_dir).where("value > 25").select("event_id", "unit", F.floor(F.col("tr") / T.RUN_TR).cast("int").alias("run"), F.explode(F.sequence(onset, onset + 2)).alias("k"))
    met = picked.join(s.select("unit", "run", "k", "value"), ["unit", "run", "k"], "left")
    return met.groupBy("event_id").agg(r6(F.coalesce(F.avg("value"), F.lit(0.0))).alias("beta"), F.count("value").alias("n"))


@query("W09 E10", f"WITH {T.SQL_S}, n AS (SELECT run, max(k) + 1 AS n FROM s GROUP BY run), t AS (SELECT s.*, (k >= round_even(n / 4.0, 0))::INT + (k >= round_even(2 * n / 4.0, 0))::INT + (k >= round_even(3 * n / 4.0, 0))::INT AS block FROM s JOIN n USING (run)), f AS (SELECT unit, run, block, avg(value) AS v FROM t GROUP BY ALL) SELECT unit, run, block // 2 AS half, round(avg(v), 6) + 0.0 AS v FROM f GROUP BY ALL")
def temporal_blocks_avg(spark, sf_dir):
    rows = T.signal(spark, sf_dir).withColumn("n", F.max("k").over(Window.partitionBy("run")) + 1)
    fine = rows.groupBy("unit", "run", W.temporal_block(F.col("k"), F.col("n"), 4).alias("block")).agg(F.avg("value").alias("v"))
    return fine.groupBy("unit", "run", F.floor(F.col("block") / 2).cast("int").alias("half")).agg(r6(F.avg("v")).alias("v"))


_STATES = f"WITH {T.SQL_H}, t AS (SELECT DISTINCT user_id % 7 AS state, tr::DOUBLE AS start, (tr + 1)::DOUBLE AS stop FROM h), r AS (SELECT *, max(stop) OVER (PARTITION BY state ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY state ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM r), m AS (SELECT state, island, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY ALL)"


def _states(spark, sf_dir):
    spans = T.hours(spark, sf_dir).select((F.col("user_id") % 7).alias("state"), F.col("tr").cast("double").alias("start"), (F.col("tr") + 1.0).alias("stop")).distinct()
    return W.merged(spans, "state")


@query("W10", _STATES + " SELECT state, CAST(island AS BIGINT) AS island, start, stop, n FROM m")
def state_ranges_merge(spark, sf_dir):
    return _states(spark, sf_dir)


@query("E06 W10", _STATES + ", c AS (SELECT state, n AS len, count(*) AS times FROM m GROUP BY ALL) SELECT state, CAST(sum(times) AS BIGINT) AS n_ranges, arg_max(len, (times, -len)) AS usual, round(max(times) / sum(times), 6) AS share FROM c GROUP BY state")
def state_content(spark, sf_dir):
    c = _states(spark, sf_dir).groupBy("state", F.col("n").alias("len")).agg(F.count("*").alias("times"))
    return c.groupBy("state").agg(F.sum("times").alias("n_ranges"), F.max_by("len", F.struct("times", -F.col("len"))).alias("usual"), F.round(F.max("times") / F.sum("times"), 6).alias("share"))


@query("W11 W12", f"WITH {T.SQL_CLIPS} SELECT video_id, round(dur * 24.0) / 24 AS snapped, CAST(floor(dur / 2.5 + 1e-9) AS BIGINT) AS n_windows, CAST(sum(dur) OVER (PARTITION BY run ORDER BY onset, video_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM clips")
def frame_snapping(spark, sf_dir):
    seen = Window.partitionBy("run").orderBy("onset", "video_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.clips(spark, sf_dir).select("video_id", (F.round(F.col("dur") * 24.0) / 24).alias("snapped"), F.floor(F.col("dur") / 2.5 + 1e-9).alias("n_windows"), F.sum("dur").over(seen).alias("cumulative"))


@query("W12 E01", f"WITH {T.SQL_S} SELECT unit, run, k, round(avg(value) OVER (PARTITION BY unit, run ORDER BY k ROWS UNBOUNDED PRECEDING) + 1.7e-10, 6) + 0.0 AS m FROM s")
def cumulative_windows(spark, sf_dir):
    upto = Window.partitionBy("unit", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return T.signal(spark, sf_dir).select("unit", "run", "k", near6(F.avg("value").over(upto)).alias("m"))


_SG = (11, 3)
_SG_SQL = ", ".join(f"({p}, {j}, {w:.17g})" for p, row in enumerate(special.savgol(*_SG)) for j, w in enumerate(row))
_SMOOTH = f"WITH {T.SQL_S}, c(p, j, w) AS (VALUES {_SG_SQL}), n AS (SELECT run, max(k) + 1 AS n FROM s GROUP BY run), o AS (SELECT s.*, greatest(0, least(k - {_SG[0] // 2}, n - {_SG[0]})) AS a FROM s JOIN n USING (run) WHERE n >= {_SG[0]}), hp AS (SELECT o.unit, o.run, o.k, o.value AS raw, any_value(o.value) - sum(t.value * w) AS value FROM o JOIN c ON p = o.k - a JOIN s t ON t.unit = o.unit AND t.run = o.run AND t.k = a + j GROUP BY o.unit, o.run, o.k, o.value)"


@query("A01", _SMOOTH + " SELECT unit, run, k, round(value, 6) + 0.0 AS v FROM hp")
def savgol_high_pass(spark, sf_dir):
    return A.high_pass(T.signal(spark, sf_dir), *_SG).select("unit", "run", "k", r6("value").alias("v"))


@query("A02", f"WITH {T.SQL_S}, m AS (SELECT *, avg(value) OVER (PARTITION BY unit, run) AS m FROM s) SELECT unit, run, k, round((value - m) / CASE WHEN abs(m) < 1e-6 THEN 1 ELSE abs(m) END * 100, 6) + 0.0 AS v FROM m")
def percent_change(spark, sf_dir):
    return A.percent_change(T.signal(spark, sf_dir)).select("unit", "run", "k", r6("value").alias("v"))


@query("A03", f"WITH {T.SQL_S} SELECT unit, run, k, round(value - avg(value) OVER (PARTITION BY run, k), 6) + 0.0 AS v FROM s")
def global_regression(spark, sf_dir):
    return A.global_regression(T.signal(spark, sf_dir)).select("unit", "run", "k", r6("value").alias("v"))


_CLEAN = _SMOOTH + ", b AS (SELECT *, avg(raw) OVER g AS base, avg(value) OVER g AS m FROM hp WINDOW g AS (PARTITION BY unit, run)), q AS (SELECT unit, run, k, (value - m) / CASE WHEN abs(base) < 1e-6 THEN 1 ELSE abs(base) END * 100 AS v FROM b), z AS (SELECT unit, run, k, round(v - avg(v) OVER (PARTITION BY run, k), 6) + 0.0 AS v FROM q)"


@query("A01 A02 A03 A04", _CLEAN + " SELECT unit, run, k, 'sg_psc_gsr' AS steps, v FROM z")
def cleaned_signal(spark, sf_dir):
    s = T.signal(spark, sf_dir)
    base = s.groupBy("unit", "run").agg(F.avg("value").alias("base"))
    rows = A.global_regression(A.percent_change(A.high_pass(s, *_SG).join(base, ["unit", "run"]), "base"))
    return rows.select("unit", "run", "k", F.concat_ws("_", F.lit("sg"), F.lit("psc"), F.lit("gsr")).alias("steps"), r6("value").alias("v"))


@query("S05 A04", _CLEAN + ", rn AS (SELECT run, max(k) + 1 AS n FROM z GROUP BY run), ro AS (SELECT run, n, coalesce(sum(n) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM rn) SELECT unit, run, CAST(n AS INT) AS run_trs, CAST(base + k AS INT) AS place, v FROM z JOIN ro USING (run)")
def cleaned_runs_in_line(spark, sf_dir):
    """Every run cleaned by itself, then all in one line: the place of a TR counts those of earlier runs."""
    rows = cleaned_signal(spark, sf_dir)
    trs = rows.groupBy("run").agg((F.max("k") + 1).cast("int").alias("run_trs"))  # a row for each run
    before = F.coalesce(F.sum("run_trs").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(trs.withColumn("before", before), "run").select("unit", "run", "run_trs", (F.col("before") + F.col("k")).cast("int").alias("place"), "v")


_HRF = special.hrf()[:16]


@query("A05 A06", f"WITH {T.SQL_S}, f(j, w) AS (VALUES {', '.join(f'({j}, {w:.17g})' for j, w in enumerate(_HRF))}) SELECT s.unit, s.run, s.k, round(sum(t.value * w), 6) + 0.0 AS v FROM s JOIN f ON j <= s.k % 24 JOIN s t ON t.unit = s.unit AND t.run = s.run AND t.k = s.k - j GROUP BY ALL")
def hrf_convolve(spark, sf_dir):
    rows = T.signal(spark, sf_dir).withColumn("clip", F.floor(F.col("k") / 24))
    return A.convolved(rows, _HRF, "unit", "run", "clip").select("unit", "run", "k", r6("value").alias("v"))


@query("A09", f"WITH {T.SQL_S}, m AS (SELECT *, avg(value) OVER g AS m, stddev_pop(value) OVER g AS sd FROM s WINDOW g AS (PARTITION BY unit, run)) SELECT unit, run, k, round(CASE WHEN sd > 1e-12 THEN (value - m) / sd ELSE 0 END, 6) + 0.0 AS v FROM m")
def runwise_standardize(spark, sf_dir):
    return W.scaled(T.signal(spark, sf_dir), "unit", "run", constant=0.0).select("unit", "run", "k", r6("value").alias("v"))


@query("F01", _BIN + ", z AS (SELECT *, (value - avg(value) OVER g) / stddev_pop(value) OVER g AS z FROM b WINDOW g AS (PARTITION BY unit, run)) SELECT unit, run, video_id, w, round(z, 6) + 0.0 AS z FROM z WHERE video_id NOT IN (3, 11)")
def drop_after_zscore(spark, sf_dir):
    rows = W.binned(T.signal(spark, sf_dir), _windows(spark, sf_dir, TUMBLE))
    return W.scaled(rows, "unit", "run").where(~F.col("video_id").isin(3, 11)).select("unit", "run", "video_id", "w", r6("value").alias("z"))


@query("A18", r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), ' '), lambda q: q <> '') AS ws FROM conversations), n AS (SELECT *, len(ws) AS n FROM t) SELECT conv_id, turn, CAST(n AS INT) AS n_words, CASE WHEN n >= 9 THEN len(list_distinct(list_transform(range(0, n - 2, 3), lambda i: array_to_string(ws[i + 1:i + 3], ' ')))) <= 2 ELSE false END AS hallucinated FROM n""")
def transcript_filter(spark, sf_dir):
    n, bad = A.hallucinated(F.col("text"))
    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n_words"), bad.alias("hallucinated"))


@query("A19", "SELECT c_custkey, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number, CASE WHEN lower(trim(c_mktsegment)) IN ('machinery', 'automobile') THEN 1 WHEN lower(trim(c_mktsegment)) IN ('household', 'furniture') THEN 0 END AS industrial, lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '-', 'g')) || '_n' || c_nationkey AS tag FROM customer")
def name_parsing(spark, sf_dir):
    kind = F.lower(F.trim("c_mktsegment"))
    return T.read(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(F.regexp_extract("c_name", "#0*([0-9]+)$", 1), F.lit("")).cast("long").alias("number"),
        F.when(kind.isin("machinery", "automobile"), 1).when(kind.isin("household", "furniture"), 0).alias("industrial"),
        F.concat(F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z0-9]+", "-")), F.lit("_n"), F.col("c_nationkey")).alias("tag"),
    )


@query("A20 U04", f"WITH {T.SQL_H}, f AS (SELECT tr, bool_or(unit = 'view') AS v, bool_or(unit = 'click') AS c, bool_or(unit = 'error') AS e FROM h GROUP BY tr) SELECT CASE WHEN v AND NOT c AND NOT e THEN 'view' WHEN c AND NOT v AND NOT e THEN 'click' WHEN v AND c AND NOT e THEN 'view+click' WHEN v AND c AND e THEN 'all' ELSE 'other' END AS condition, count(*) AS n FROM f GROUP BY 1")
def condition_masks(spark, sf_dir):
    v, c, e = F.col("v"), F.col("c"), F.col("e")
    f = T.hours(spark, sf_dir).groupBy("tr").agg(*[F.bool_or(F.col("unit") == u).alias(u[0]) for u in ("view", "click", "error")])
    kind = F.when(v & ~c & ~e, "view").when(c & ~v & ~e, "click").when(v & c & ~e, "view+click").when(v & c & e, "all").otherwise("other")
    return f.groupBy(kind.alias("condition")).agg(F.count("*").alias("n"))


@query("A12 A13", f"WITH {T.SQL_SUB}, t AS (SELECT unit, corr(value, block) AS r, count(*) AS n FROM sub GROUP BY unit) SELECT unit, round(atanh(greatest(-0.999999, least(r, 0.999999))), 6) + 0.0 AS z, round(sign(r) * -log10(greatest(exp(-abs(r) * sqrt(n)), 1.1754943508222875e-38)), 6) + 0.0 AS signed FROM t")
def signed_log_maps(spark, sf_dir):
    rows = T.subjects(spark, sf_dir).groupBy("unit").agg(F.corr("value", "block").alias("r"), F.count("*").alias("n"))
    r = F.col("r")
    return rows.select("unit", r6(A.fisher_z(r)).alias("z"), r6(A.signed_log_p(F.exp(-F.abs(r) * F.sqrt("n")), r)).alias("signed"))


@query("A14", f"WITH {T.SQL_V} SELECT vec_id, CAST(1 + least(floor((greatest(-0.3, least(x[2], 0.3)) + 0.3) / 0.6 * 8), 7) * 8 + least(floor((greatest(-0.3, least(x[1], 0.3)) + 0.3) / 0.6 * 8), 7) AS INT) AS key FROM v")
def bivariate_keys(spark, sf_dir):
    return T.patterns(spark, sf_dir).select("vec_id", A.bivariate_key(F.col("x")[0], F.col("x")[1], 8, -0.3, 0.3).alias("key"))


@query("A16", f"WITH {T.SQL_V} SELECT vec_id, round(sqrt(greatest(x[1], 0) * greatest(x[2], 0)), 6) + 0.0 AS joint, round((x[1] - x[2]) / (abs(x[1]) + abs(x[2]) + 1e-8), 6) + 0.0 AS balance FROM v")
def geomean_balance(spark, sf_dir):
    a, b = F.col("x")[0], F.col("x")[1]
    return T.patterns(spark, sf_dir).select("vec_id", r6(A.joint(a, b)).alias("joint"), r6(A.balance(a, b)).alias("balance"))
