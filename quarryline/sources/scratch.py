"""Tables that a session writes for itself, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; in local mode one of our own where none is set. A cluster's machines share none unless it is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at; what will be there goes when the session ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: later plans start from it, and it survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_made: dict[tuple, str] = {}


def once(source: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The path of what build writes from a file table, once for the session and the table's files as they are now."""
    spark = source.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    now = files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns)), F.min("file_path"), F.max("file_path")).first()
    key = (spark.sparkContext.applicationId, name, *now)
    if key not in _made:
        path = new_path(spark, name)
        build(path)
        _made[key] = path
    return _made[key]
