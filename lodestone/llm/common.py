"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lodestone

# Functions of this package travel to the executors by value, so they need no install there.
cloudpickle.register_pickle_by_value(lodestone)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse, which on a cluster must not be a folder of one machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = f"{sc.applicationId}@{root}"
    if key not in _folders:
        _folders[key] = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[key])
    return _folders[key]


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start there, also after an executor is lost.

    Its shuffle files go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_key(doc_id: Column, digest: Column) -> Column:
    """One text key of an id, which may be null, and a digest of the row's text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), digest)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on the keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is not broadcast: Spark sizes a table by its compressed files, and its rows in memory may be twenty times that."""
    return df.hint("merge")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 1000, small: bool = False) -> DataFrame:
    """Inner join of rows to their group's record, however large a group is.

    groups has one record per key, with the number of its rows in `size` (both frames are read twice, so
    stage them). Keys that hold more than 1/share of all rows are fewer than `share` by counting, so those
    records are broadcast and their rows stay where they are; the rest join by a shuffle in which no key
    has more than 1/share of the rows. With `small`, Spark may broadcast those records too, if it takes them for small:
    for keys that are hashes, whose files are not much smaller than their rows.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = total // share
    hot = groups.where(F.col(size) > limit).withColumnsRenamed({k: f"_{k}" for k in keys})
    cold = groups.where(F.col(size) <= limit).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    near = rows.join(F.broadcast(hot), on, "inner")
    far = rows.join(F.broadcast(hot.select([f"_{k}" for k in keys])), on, "left_anti").join(cold if small else shuffled(cold), on, "inner")
    return near.unionByName(far).drop(*[f"_{k}" for k in keys])
