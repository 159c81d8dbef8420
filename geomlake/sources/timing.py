"""Text sources: sectioned timing sheets, id lists, label tables with a strict schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLIPS = "video_id STRING, onset_sec DOUBLE, end_sec DOUBLE, duration_sec DOUBLE, run_id INT"


def clip_timing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CLIPS)


def parsed_sheet(lines: DataFrame) -> DataFrame:
    """run, label, is_rest, start, stop of a sheet's lines (line_no, line), with sheet as the group.

    A line `run N` opens a run; other lines are `label,start,stop`; label 0 is rest; the rest is skipped.
    """
    text = F.trim(F.regexp_replace("line", "\r", ""))
    w = Window.partitionBy("sheet").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.lower(text).rlike("^run +[0-9]+$"), F.regexp_extract(text, "([0-9]+)$", 1).cast("int")), ignorenulls=True).over(w)
    parts = F.split(text, ",")
    rows = lines.select("sheet", "line_no", run.alias("run"), F.trim(F.get(parts, F.lit(0))).alias("label"), F.get(parts, F.lit(1)).try_cast("double").alias("start"), F.get(parts, F.lit(2)).try_cast("double").alias("stop"), F.size(parts).alias("n"))
    rows = rows.where("n = 3 AND run IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    return rows.select("sheet", "run", "label", (F.col("label") == "0").alias("is_rest"), "start", "stop")


def timing_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet file: one text of a few hundred lines, kept in order by its line number."""
    lines = spark.read.text(path, wholetext=True).select(F.lit(path).alias("sheet"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parsed_sheet(lines)


def id_list(lines: DataFrame, line: str = "value", first_token: bool = False) -> DataFrame:
    """id of every line that is neither blank nor a comment; the whole line or its first token."""
    text = F.trim(F.col(line))
    kept = lines.where((text != "") & ~text.startswith("#"))
    return kept.select((F.split(text, "[ \t]+")[0] if first_token else text).alias("id"))


def strict_classes(rows: DataFrame, n: int, index: str, label: str, known: tuple[str, ...]) -> DataFrame:
    """What is wrong with a class table: problem, place. A good one gives no row.

    index must hold 0..n-1 once each, and label must be one of `known`, each of which must occur.
    """
    spark = rows.sparkSession
    whole = spark.range(n).select(F.col("id").alias("place"))
    have = rows.select(F.col(index).cast("long").alias("place"), F.col(label).alias("class"))
    missing = whole.join(have.select("place").distinct(), "place", "left_anti").select(F.lit("missing").alias("problem"), F.col("place").cast("string").alias("place"))
    extra = have.groupBy("place").count().where(f"count > 1 OR place < 0 OR place >= {n}").select(F.lit("index").alias("problem"), F.col("place").cast("string").alias("place"))
    unknown = have.where(~F.col("class").isin(*known) | F.col("class").isNull()).select(F.lit("class").alias("problem"), F.coalesce("class", F.lit("null")).alias("place")).distinct()
    names = spark.createDataFrame([(k,) for k in known], "class string")
    empty = names.join(have.select("class").distinct(), "class", "left_anti").select(F.lit("empty").alias("problem"), F.col("class").alias("place"))
    return missing.union(extra).union(unknown).union(empty)


def expected_files(wanted: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """The wanted keys that are not present."""
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")


def roi_means(signal: DataFrame, masks: DataFrame) -> DataFrame:
    """roi, run, k, value: means of several overlapping masks (roi, unit) in one pass over the signal."""
    return signal.join(F.broadcast(masks), "unit").groupBy("roi", "run", "k").agg(F.avg("value").alias("value"))  # masks: regions by units


def prefix_matches(columns: list[str], name: str) -> str:
    """The column of this name, exactly or else without regard to case."""
    exact = [c for c in columns if c == name] or [c for c in columns if c.lower() == name.lower()]
    if len(exact) != 1:
        raise KeyError(f"no single column {name!r} in {columns}")
    return exact[0]
