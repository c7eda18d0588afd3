"""A table of chunks and their vectors under a folder: buckets of Parquet by key, and a manifest for each version.

A write makes new folders for the buckets that it touches and then puts the number of the new manifest into one small file, in one step. Until then
readers see the old version, whatever became of the writer. One writer at a time: a second one that began from the same version is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.registry import query, table
from lodestone.storage import read_text, shared_root, swap_text

#: Folders that a store is dealt over; a write touches at most all of them.
BUCKETS = 64
# Fixed value: what a store holds for a year without quarters.
NO_QUARTER = 0
QUARTER = "fiscal_quarter"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Version, width of vectors, rows, and the folder and rows of each bucket; a store that was never written has version 0."""
    if version is None:
        current = read_text(spark, f"{root}/current")
        if current is None:
            return {"version": 0, "width": None, "rows": 0, "buckets": {}}
        version = int(current)
    text = read_text(spark, f"{root}/manifest-{version}.json")
    if text is None:
        raise FileNotFoundError(f"no version {version} in {root}")
    return json.loads(text)


def read(spark: SparkSession, root: str, version: int | None = None, keys: list | None = None) -> DataFrame:
    """The rows of a version, the current one by default; a quarter of NO_QUARTER comes back as null."""
    m = manifest(spark, root, version)
    if not m["version"]:
        raise FileNotFoundError(f"no store in {root}")
    folders = [b["folder"] for k, b in m["buckets"].items() if keys is None or int(k) in keys]
    rows = spark.read.schema(m["schema"]).parquet(*folders) if folders else spark.createDataFrame([], m["schema"])
    return rows.withColumn(QUARTER, F.nullif(QUARTER, F.lit(NO_QUARTER))) if QUARTER in rows.columns else rows


def count(spark: SparkSession, root: str, version: int | None = None) -> int:
    return manifest(spark, root, version)["rows"]


def paired(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors; a chunk without a vector or a vector without a chunk is a ValueError."""
    n, m = chunks.count(), vectors.count()
    both = chunks.join(vectors, key)
    if n != m or both.count() != n:
        raise ValueError(f"{n} chunks but {m} vectors, or keys that don't meet")
    return both


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def upsert(rows: DataFrame, root: str, key: str = "chunk_id", vector: str = "embedding", order: str | None = None) -> dict:
    """Writes rows, in the place of those that have their key; of a key given more than once the one of greatest `order` stays (then of greatest hash).

    Null keys, null vectors and vectors of another width than the store's are a ValueError. No rows, no new version.
    """
    given = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), F.desc(F.xxhash64(*rows.columns)))))
    return _commit(given.where("_n = 1").drop("_n"), root, key, vector)


def append(rows: DataFrame, root: str, key: str = "chunk_id", vector: str = "embedding") -> dict:
    """Writes rows whose keys are new; a key that is there already, or comes twice, is a ValueError: it would be stored twice."""
    spark = rows.sparkSession
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key comes twice")
    if manifest(spark, root)["version"] and rows.join(read(spark, root).select(key), key, "left_semi").limit(1).count():
        raise ValueError("a key is there already; build the store again")
    return _commit(rows, root, key, vector)


def _commit(rows: DataFrame, root: str, key: str, vector: str) -> dict:
    spark, old = rows.sparkSession, manifest(rows.sparkSession, root)
    width = F.size(vector)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("least"), F.max(width).alias("most"), F.count_if(F.col(key).isNull() | F.col(vector).isNull()).alias("nulls")).first()
    if not seen.n:
        return old
    expected = old["width"] or seen.most
    if seen.nulls:
        raise ValueError(f"{seen.nulls} rows without a key or a vector")
    if (seen.least, seen.most) != (expected, expected):
        raise ValueError(f"expected {expected}-dimensional vectors, got {seen.least} to {seen.most}")
    if QUARTER in rows.columns:
        rows = rows.withColumn(QUARTER, F.coalesce(QUARTER, F.lit(NO_QUARTER)))
    new = rows.withColumn("bucket", _bucket(key))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most BUCKETS
    if old["version"]:
        kept = read(spark, root, keys=touched)
        if QUARTER in kept.columns:
            kept = kept.withColumn(QUARTER, F.coalesce(QUARTER, F.lit(NO_QUARTER)))
        kept = kept.join(rows.select(key), key, "left_anti")
        new = kept.withColumn("bucket", _bucket(key)).select(new.columns).unionByName(new)
    folder = f"{root}/data-{uuid.uuid4().hex}"
    new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    sizes = {r.bucket: r["count"] for r in spark.read.parquet(folder).groupBy("bucket").count().collect()}
    buckets = old["buckets"] | {str(b): {"folder": f"{folder}/bucket={b}", "rows": sizes[b]} for b in touched}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = {"version": old["version"] + 1, "width": expected, "rows": sum(b["rows"] for b in buckets.values()), "schema": schema, "buckets": buckets}
    if manifest(spark, root)["version"] != old["version"]:
        raise RuntimeError("another writer was faster")
    swap_text(spark, f"{root}/manifest-{made['version']}.json", json.dumps(made))
    swap_text(spark, f"{root}/current", str(made["version"]))
    return made


@query(
    "WITH e AS (SELECT vec_id, label, vec_id % 5 AS q FROM embeddings), v AS (SELECT 1 AS version, vec_id, label, q FROM e WHERE vec_id % 3 <> 0 UNION ALL SELECT 2, vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END, q FROM e WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0) "
    "SELECT version::INT AS version, label, count(*) AS n, count(*) FILTER (q = 0) AS no_quarter, sum(vec_id)::BIGINT AS ids FROM (SELECT * FROM v UNION ALL SELECT 3, vec_id, label, q FROM v WHERE version = 2) GROUP BY ALL"
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes of vectors to a store, the third a repetition of the second: what each version holds."""
    root = f"{shared_root(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").withColumn(QUARTER, F.nullif((F.col("vec_id") % 5).cast("int"), F.lit(0)))
    changed = rows.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100).select(rows.columns)
    append(rows.where("vec_id % 3 <> 0"), root, "vec_id")
    upsert(changed, root, "vec_id")
    upsert(changed, root, "vec_id")
    found = [read(spark, root, v).select(F.lit(v).alias("version"), "label", "vec_id", QUARTER) for v in (1, 2, 3)]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("version", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(QUARTER).isNull()).alias("no_quarter"), F.sum("vec_id").alias("ids"))
