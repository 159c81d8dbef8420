"""The data model's canonical tables, built from the Parquet tables at hand.

embeddings are patterns (condition by feature, labels as runs, clips or parcels); events are a
continuous signal (unit = event type, TR = hour, run = week, clip = day); lineitem gives subjects
(suppliers), units (return flag and line status) and blocks (ship years).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomlake.functions import vectors as V

RUN_TR = 168


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x (array of double)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("x"))


#: The same in SQL: common table expressions v (patterns), c (centred and unit: z), e (long: d from 0).
SQL_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda q: q::DOUBLE) AS x FROM embeddings)"
SQL_C = SQL_V + """, c0 AS (SELECT vec_id, label, x, list_avg(x) AS m FROM v),
 c1 AS (SELECT vec_id, label, x, list_transform(x, lambda q: q - m) AS y FROM c0),
 c2 AS (SELECT vec_id, label, x, y, sqrt(list_inner_product(y, y)) AS n FROM c1),
 c AS (SELECT vec_id, label, x, y, list_transform(y, lambda q: q / n) AS z FROM c2)"""
SQL_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS d FROM embeddings)"


def long_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, d (from 0), x."""
    return patterns(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("d", "x"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their unit and hour (from 2024-01-01)."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("unit"), F.timestamp_diff("HOUR", start, F.col("ts")).cast("int").alias("tr"), "value")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, run, tr (global), k (TR in its run), value: mean of an hour's values, 0 without any."""
    seen = hours(spark, sf_dir).groupBy("unit", "tr").agg(F.avg("value").alias("value"))
    span = seen.agg(F.max("tr").alias("last"))
    grid = seen.select("unit").distinct().join(F.broadcast(span)).select("unit", F.explode(F.sequence(F.lit(0), "last")).alias("tr"))
    full = grid.join(seen, ["unit", "tr"], "left")
    return full.select("unit", F.floor(F.col("tr") / RUN_TR).cast("int").alias("run"), "tr", (F.col("tr") % RUN_TR).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))


SQL_H = "h AS (SELECT event_id, user_id, event_type AS unit, date_diff('hour', TIMESTAMP '2024-01-01', ts)::INT AS tr, value FROM events)"
SQL_S = SQL_H + f""", s0 AS (SELECT unit, tr, avg(value) AS value FROM h GROUP BY ALL),
 s AS (SELECT unit, tr // {RUN_TR} AS run, tr, tr % {RUN_TR} AS k, coalesce(value, 0.0) AS value
  FROM (SELECT unit, unnest(range(0, (SELECT max(tr) + 1 FROM s0)))::INT AS tr FROM (SELECT DISTINCT unit FROM s0)) LEFT JOIN s0 USING (unit, tr))"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each day with events: video_id, run, onset, dur (in TRs, global)."""
    days = hours(spark, sf_dir).groupBy(F.floor(F.col("tr") / 24).cast("int").alias("video_id")).agg(F.min("tr").alias("onset"), (F.max("tr") - F.min("tr") + 1).alias("dur"))
    return days.select("video_id", F.floor(F.col("onset") / RUN_TR).cast("int").alias("run"), "onset", "dur")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, n_tr."""
    return hours(spark, sf_dir).groupBy(F.floor(F.col("tr") / RUN_TR).cast("int").alias("run")).agg((F.max(F.col("tr") % RUN_TR) + 1).alias("n_tr"))


SQL_CLIPS = SQL_H + f""", clips AS (SELECT tr // 24 AS video_id, min(tr) // {RUN_TR} AS run, min(tr) AS onset, max(tr) - min(tr) + 1 AS dur FROM h GROUP BY tr // 24),
 runs AS (SELECT tr // {RUN_TR} AS run, max(tr % {RUN_TR}) + 1 AS n_tr FROM h GROUP BY ALL)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (supplier), unit (return flag and status), block (ship year), value (mean discounted price in thousands)."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("unit"), F.year("l_shipdate").alias("block"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("value"))
    return rows.groupBy("subject", "unit", "block").agg(F.avg("value").alias("value"))


SQL_SUB = "sub AS (SELECT l_suppkey AS subject, l_returnflag || l_linestatus AS unit, year(l_shipdate)::INT AS block, avg(l_extendedprice * (1 - l_discount) / 1000) AS value FROM lineitem GROUP BY ALL)"
