"""Streaming forms: event-time windows with a watermark, and running means with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomlake.sources import store


def windowed(events: DataFrame, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """keys, start, n, m of `value` in event-time windows; works on streams and tables alike."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "m")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """key, start, stop, n of runs of events with no gap longer than `gap`."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now, into a table in the shared folder."""
    spark = stream.sparkSession
    path, marks = store.shared_folder(spark, name), store.shared_folder(spark, f"{name}-marks")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def day_means(spark: SparkSession, path: str) -> DataFrame:
    """unit, day, n, m: partial sums of each micro-batch, written once per batch and added up at the end.

    Sums, not means, are stored, so a batch that is repeated overwrites its own rows alone and days
    may spread over batches.
    """
    schema = spark.read.parquet(path).select("ts", "event_type", "value").schema
    folder, file = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{file[:-8]}*{file[-8:]}")
    partial = store.shared_folder(spark, "day-sums")

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.col("event_type").alias("unit"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count("value").alias("nv"), F.sum("value").alias("s"))
        sums.write.mode("overwrite").parquet(f"{partial}/batch={number}")

    events.writeStream.option("checkpointLocation", store.shared_folder(spark, "day-marks")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(partial).groupBy("unit", "day").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("nv"), 6).alias("m"))
