"""Window construction over continuous signals: time bins inside clips and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_offsets(runs: DataFrame) -> DataFrame:
    """run, n_tr and start_tr, the TRs of all runs before it. One row per run: small by nature."""
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start_tr", F.coalesce(F.sum("n_tr").over(before), F.lit(0)).cast("int"))


def full_count(dur: Column, width: int, stride: int) -> Column:
    """Windows that a clip of this duration has room for."""
    return F.when(dur >= width, F.floor((dur - width) / stride) + 1).otherwise(0).cast("int")


def window_index(clips: DataFrame, runs: DataFrame, width: int, stride: int, delay: int = 0, tr: float = 1.0) -> DataFrame:
    """video_id, run, w (number in its clip), start and stop (TRs in the run), row_idx (place among all full windows).

    A clip that starts outside its run gives nothing, and the windows end with the run, but
    row_idx counts all windows that the clips have room for. Starts round half to even.
    """
    order = Window.orderBy("run", "onset", "video_id").rowsBetween(Window.unboundedPreceding, -1)
    held = clips.join(F.broadcast(run_offsets(runs)), "run").withColumn("n", full_count(F.col("dur"), width, stride))
    held = held.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("int"))
    held = held.withColumn("first", F.bround((F.col("onset") - F.col("start_tr") + delay) / F.lit(tr)).cast("int")).where("first >= 0 AND first < n_tr AND n > 0")
    rows = held.select("video_id", "run", "n_tr", "first", "base", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
    steps = (F.bround(F.lit(width) / F.lit(tr)).cast("int"), F.bround(F.lit(stride) / F.lit(tr)).cast("int"))
    start = F.col("first") + F.col("w") * steps[1]
    rows = rows.select("video_id", "run", "w", start.alias("start"), (start + steps[0]).alias("stop"), (F.col("base") + F.col("w")).alias("row_idx"), "n_tr")
    return rows.where("stop <= n_tr").drop("n_tr")


def binned(signal: DataFrame, windows: DataFrame, *more: str) -> DataFrame:
    """Mean of each unit in each window: a window's TRs are exploded, so the range join is an equi-join.

    signal: unit, run, k, value. Keeps video_id, w and the columns named in more.
    """
    trs = windows.select("video_id", "run", "w", *more, F.explode(F.sequence("start", F.col("stop") - 1)).alias("k"))
    return signal.join(trs, ["run", "k"]).groupBy("unit", "run", "video_id", "w", *more).agg(F.avg("value").alias("value"))


def scaled(rows: DataFrame, *groups: str, value: str = "value", how: str = "zscore", constant: float | None = None) -> DataFrame:
    """Centres or z-scores (population) inside groups; a constant group gives null, or `constant`."""
    w = Window.partitionBy(*groups)
    centred = F.col(value) - F.avg(value).over(w)
    if how == "center":
        return rows.withColumn(value, centred)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn(value, F.when(sd > 1e-12, centred / sd).otherwise(F.lit(constant)))


def inside(signal: DataFrame, spans: DataFrame, k: str = "k") -> DataFrame:
    """The signal's rows that lie in any [start, stop) of spans (run, start, stop)."""
    trs = spans.select("run", F.explode(F.sequence("start", F.col("stop") - 1)).alias(k)).where(F.col(k).isNotNull()).distinct()
    return signal.join(trs, ["run", k], "left_semi")


def merged(spans: DataFrame, *groups: str, gap: float = 0.01) -> DataFrame:
    """Ranges (start, stop) of each group that touch, give or take `gap`, become one."""
    w = Window.partitionBy(*groups).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*groups, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"))


def block_edges(n_rows: Column, n_blocks: int, b: Column) -> Column:
    """Edge b of n_blocks blocks of n_rows rows: a rounded even spacing."""
    return F.bround(b * n_rows / F.lit(float(n_blocks))).cast("int")


def temporal_block(row: Column, n_rows: Column, n_blocks: int) -> Column:
    """Number of the block, by block_edges, that a row (from 0) lies in."""
    past = [F.when(row >= block_edges(n_rows, n_blocks, F.lit(float(b))), 1).otherwise(0) for b in range(1, n_blocks)]
    return sum(past[1:], past[0]) if past else F.lit(0)
