"""Map tables on disk: partitioned writes, keyed upserts, resumable work, and stored intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all executors share; removed at the end of the session."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="geomlake-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/geomlake/{name}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_folder(folder: str, columns: list[str]) -> pa.Table:
    """The rows of a folder's Parquet files, inside a task; a folder that isn't there is an error."""
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    place, path = pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
    names = sorted(f.path for f in place.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    return pa.concat_tables(pq.ParquetFile(place.open_input_file(name)).read(columns) for name in names)


def write_maps(maps: DataFrame, path: str) -> None:
    """Writes map_name, unit_id, value, one folder for each map; the rows are first brought together by map."""
    maps.repartition("map_name").write.mode("overwrite").partitionBy("map_name").parquet(path)


def upsert_maps(maps: DataFrame, path: str) -> None:
    """Replaces maps of the same name, adds new ones, leaves the others as they are."""
    maps.repartition("map_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("map_name").parquet(path)


def read_maps(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The maps, or the named ones, by partition pruning; an unknown name is a KeyError."""
    maps = spark.read.parquet(path)
    if names:
        known = {r["map_name"] for r in maps.select("map_name").distinct().collect()}
        if missing := set(names) - known:
            raise KeyError(f"no map named {sorted(missing)}")
        maps = maps.where(F.col("map_name").isin(*names))
    return maps


def missing_maps(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The wanted map_names that are not stored yet: what is left to do after an interruption."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return wanted
    return wanted.join(spark.read.parquet(path).select("map_name").distinct(), "map_name", "left_anti")


def consolidated(tables: list[DataFrame], *keys: str) -> DataFrame:
    """One table of many, each key once: the first table's row stands."""
    marked = [t.withColumn("_at", F.lit(i)) for i, t in enumerate(tables)]
    out = marked[0]
    for t in marked[1:]:
        out = out.unionByName(t)
    rest = [c for c in tables[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_at").alias("_r")).select(*keys, "_r.*")


def block_stack(blocks: DataFrame, n: int) -> DataFrame:
    """subject, unit, block, value of n blocks from stored stacks (n_blocks, subject, unit, block, value).

    Takes the stack with the fewest blocks that n divides and averages neighbours.
    """
    fit = blocks.where(F.col("n_blocks") % n == 0)
    least = fit.agg(F.min("n_blocks").alias("n_blocks"))
    held = fit.join(F.broadcast(least), "n_blocks")  # one row
    place = F.floor(F.col("block") / (F.col("n_blocks") / n)).cast("int")
    return held.groupBy("subject", "unit", place.alias("block")).agg(F.avg("value").alias("value"))
