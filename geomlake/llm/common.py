"""Shared folders, table reads and Arrow batching for the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside an Arrow batch; bounds a Python worker's memory.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; a cluster gets an error,
    as a folder of the driver's machine is not visible to its executors.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="geomlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/geomlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that saved() wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as workers open it, and the path there."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def files(folder: str) -> list[str]:
    """The URIs of the Parquet files in a folder, by name; none if it isn't there."""
    place, path = store(folder)
    found = place.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.base_name.endswith(".parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the named columns, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of whole rows with about `limit` bytes in `column`.

    A single longer row comes alone; no text is cut.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
WORD_GAPS = re.compile(r"[\x20\x09-\x0D]+")
