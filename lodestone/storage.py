"""Folders that driver and executors share, for tables that a later plan starts from."""

from __future__ import annotations

import atexit
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lodestone

# Functions of this package travel to the executors by value, so they need no install there.
cloudpickle.register_pickle_by_value(lodestone)

_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the warehouse; a folder of this machine alone is refused unless the session is local."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        p, fs = _path(spark, path)
        fs.delete(p, True)


def landed(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df, written to the shared folder and read back; it stays until the session's Python ends.

    With `rows` a file has no more rows than that: a scan decodes thousands of a file's rows at once, whatever they weigh.
    """
    spark = df.sparkSession
    key = f"{spark.sparkContext.applicationId}@{shared_root(spark)}"
    if key not in _folders:
        _folders[key] = f"{shared_root(spark)}/lodestone-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _folders[key])
    path = f"{_folders[key]}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, content: str) -> None:
    """Puts a small file in the place of what is there in one step: readers see the old or the new content."""
    jvm = spark.sparkContext._jvm
    temp, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    target, _ = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temp, target, options)
