"""Given tables, and results that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: A single file below one input split is read by one task, however many cores there are; such a table is dealt out.
SPLIT_BYTES = 128 << 20
DEALT_BYTES = 16 << 20  # of its files that a task gets of a table that is dealt


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; if fewer tasks than cores would have rows to read, its rows are dealt by its first column.

    That is so for a small file, and for large ones of few row groups, which Spark can't split.  Tables of as many files as
    cores, and those of many row groups, are read as Spark splits them, without this shuffle.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if cores > 1:
        found = [r.length for r in spark.read.format("binaryFile").load(path).select("length").limit(cores).collect()]  # names and sizes only; no file is read
        if len(found) < cores and sum(found) > (1 << 18):
            small = len(found) == 1 and found[0] < SPLIT_BYTES
            if small or df.select("_metadata.file_path", "_metadata.file_block_start").distinct().count() < cores:  # footers only
                return df.repartition(max(cores, sum(found) // DEALT_BYTES), df.columns[0])
    return df


def parts(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) a folder of our own stands in, one for the process.  On a cluster
    without the setting there is no folder that all executors share, and that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lodestone-")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several branches use is computed once, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it lies; none is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
