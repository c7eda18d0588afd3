"""Incremental ingest as a stream: new files once, the latest row per key, unchanged content left alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.registry import query, table
from lodestone.storage import remove, shared_root


def changed(rows: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content is not what is stored under their key: a hash anti-join."""
    known = stored.select(key, F.sha2(content, 256).alias("_sha"))
    return rows.withColumn("_sha", F.sha2(content, 256)).join(known, [key, "_sha"], "left_anti").drop("_sha")


def latest_changes(rows: DataFrame, known: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """What a batch of rows (key, order, content) brings: of each key the latest row, if it is later than what is known (key, order, sha).

    Columns: key, order, sha (the content's digest), content (null if the digest is the known one), again (whether the key was known).
    Ties of order go to the greater content; rows without a key are one key; null content is empty. A key's rows meet in an aggregate
    and its known row in a join, so the cost of a key is that of its rows.
    """
    latest = rows.select(key, order, F.coalesce(content, F.lit("")).alias(content)).groupBy(key).agg(F.max(F.struct(order, content)).alias("_now"))
    latest = latest.select(F.col(key), F.col("_now")[order].alias(order), F.col("_now")[content].alias(content)).withColumn("sha", F.sha2(content, 256))
    last = known.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col("sha").alias("_sha"))
    met = latest.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_order").isNull() | (F.col(order) > F.col("_order")))
    same = F.col("sha").eqNullSafe(F.col("_sha"))
    return met.select(key, order, "sha", F.when(~same, F.col(content)).alias(content), F.col("_sha").isNotNull().alias("again"))


def ingest(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, key: str, order: str, content: str) -> StreamingQuery:
    """Takes the files that came since the last run, once each, and appends what they change to the sink; ends when there is no more.

    Two streams: the first lands the changes of each batch and what is known of all keys after it (the order and digest of a key's last
    content, whatever the number of its versions) under the batch's number, the second moves the landed changes into the sink. All is in
    the checkpoint: a batch that is killed is made again from what was known before it and takes the place of what it left, and the second
    starts when the first has ended, so a run that is killed goes on where it was, and a file read twice is written once. The landed
    changes are deleted once they are in the sink.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    kinds = dict(rows.dtypes)
    kept = f"{key} {kinds[key]}, {order} {kinds[order]}, sha string"
    taken = f"{key} {kinds[key]}, {order} {kinds[order]}, sha string, {content} string, again boolean"

    def land(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(kept).parquet(f"{checkpoint}/known/{number - 1}") if number else batch.limit(0).select(key, order, F.lit(None).cast("string").alias("sha"))
        latest_changes(batch, known, key, order, content).write.mode("overwrite").parquet(f"{checkpoint}/taken/{number}")
        new = own.read.schema(taken).parquet(f"{checkpoint}/taken/{number}").select(key, order, "sha")
        old = known.join(new.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        old.unionByName(new).write.mode("overwrite").parquet(f"{checkpoint}/known/{number}")
        remove(own, f"{checkpoint}/known/{number - 2}")

    rows.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint}/read").trigger(availableNow=True).start().awaitTermination()
    changes = spark.readStream.schema(taken).option("cleanSource", "delete").parquet(f"{checkpoint}/taken/*")
    out = changes.where(F.col(content).isNotNull()).select(key, order, content, "again")
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{checkpoint}/written").outputMode("append").trigger(availableNow=True).start()


@query(
    "SELECT doc_id, 1::BIGINT AS version, md5(text) AS digest, false AS again FROM documents WHERE doc_id % 3 <> 0 UNION ALL "
    "SELECT doc_id, 2, md5(CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END), doc_id % 3 <> 0 FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0"
)
def streamed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three waves of files, each taken by a run of its own: two thirds of the documents, all with every other one changed, and the same once more."""
    root, docs = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = docs.select("doc_id", F.lit(2).cast("long").alias("version"), text.alias("text"))
    waves = [docs.where("doc_id % 3 <> 0").select("doc_id", F.lit(1).cast("long").alias("version"), "text"), second, second.withColumn("version", F.lit(3).cast("long"))]
    for wave in waves:
        wave.write.mode("append").parquet(f"{root}/in")
        ingest(spark, f"{root}/in", "doc_id long, version long, text string", f"{root}/out", f"{root}/checkpoint", "doc_id", "version", "text").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "version", F.md5("text").alias("digest"), "again")


@query("SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.text IS NOT DISTINCT FROM c.text)")
def changed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say something other than the turn before, by content hash."""
    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.sha2("text", 256).alias("sha")).distinct()
    now = rows.withColumn("sha", F.sha2("text", 256))
    on = (now["conv_id"] == before["conv_id"]) & (now["turn"] == before["turn"]) & now["sha"].eqNullSafe(before["sha"])
    return now.join(before, on, "left_anti").select("conv_id", "turn", "role")


@query(
    "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
)
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums of a kind of event: the batch form of the windowed stream."""
    day = F.window("ts", "1 day").getField("start").alias("day")
    return table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
