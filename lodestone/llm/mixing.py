"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import row_key, staged

#: Copies of each source's plan that its rows are dealt to, and buckets of the sampling key in a source.
SALTS, BUCKETS = 256, 4096
WORD = r"[^\x20\x09-\x0D]+"
JUNK = "%$#&*|"


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1 that falls with the share of symbols in the text."""
    symbols = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(2.0) * symbols / F.greatest(F.lit(1), F.length(text)))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """An exponential variable of rate `weight`, the same in every run: small keys come first."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10)
    return -F.ln((digits.cast("double") + 0.5) / F.lit(float(1 << 48))) / weight


def source_targets(sizes: DataFrame, ratio: float, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """The target of each source: shares by repeating weights, held at `epochs` times its size, the rest reshared.

    Sources in ascending order of size per weight reach their ceiling first; with what is left and the
    weights left, the first that does not reach it fixes the level for all others.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * epochs)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.lit(float(ratio)) * F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(after))
    free = F.col("left") * F.col("weight") <= F.col("ceiling") * F.col("weight_left")
    level = F.min(F.when(free, F.struct(F.col("ceiling") / F.col("weight"), F.col("left") / F.col("weight_left")))).over(everything)
    s = s.withColumn("free", free).withColumn("level", level.getField("col2"))
    target = F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("ceiling")).cast("double")
    return s.select("source", "source_size", target.alias("target"))


def _row(text: Column) -> Column:
    """A key of a row's id, text and source."""
    return row_key(F.col("doc_id"), F.concat(F.hex(F.xxhash64(text)), F.lit(" "), F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, sampling key and its bucket, and row: a key of the id and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), quality(text).alias("w"), _row(text).alias("row"))
    u = F.exp(-sampling_key(F.col("doc_id"), F.col("w")))
    bucket = F.floor((1 - u) * BUCKETS).cast("int").alias("bucket")
    return staged(rows.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("w")).alias("key"), bucket, "row"), "sizes")


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 2) -> DataFrame:
    """How many words the mix takes of each document.

    Columns: doc_id, source, size, source_size, target, taken. A source's target is met by complete epochs
    of all its documents, then by a part epoch: documents in order of their sampling key until the budget is
    used; the document that the budget ends in gives its first words. Null text has size 0, null is a source
    of its own, the last. Ties of the key fall to doc_id and size; repeated rows are documents of their own.
    """
    return _mixed(_rows(docs), ratio, weights, epochs).drop("row")


def _mixed(rows: DataFrame, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 2) -> DataFrame:
    """mix() of the rows that _rows() makes, with their row keys."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, ratio, weights, epochs)
    whole = F.coalesce(F.try_divide(F.floor("target"), F.col("source_size")).cast("long"), F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("room", F.floor("target") - F.col("whole") * F.col("source_size"))

    up_to = Window.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(up_to))
    plan = staged(plan, "targets")
    rooms = plan.select(F.col("source").alias("_s"), "room")
    cut = sums.join(rooms, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("upto") >= F.col("room"))
    cut = cut.groupBy("_s").agg(F.min(F.struct("bucket", (F.col("room") - F.col("upto") + F.col("n")).alias("rest"))).alias("cut"))
    plan = staged(plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")

    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_s")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    on = (rows["salt"] == salted["salt"]) & rows["source"].eqNullSafe(salted["_s"])
    rows = rows.join(salted, on).drop("salt", "_s")
    at, edge = F.col("bucket"), F.col("cut.bucket")
    clear = rows.where(~at.eqNullSafe(edge)).withColumn("part", F.when(at < edge, F.col("size")).otherwise(0))
    in_turn = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("cut.rest") - F.coalesce(F.sum("size").over(in_turn), F.lit(0))
    shared = rows.where(at == edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return clear.unionByName(shared).select("doc_id", "source", "size", "source_size", "target", taken, "row")


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself, with the columns of docs: a document once per epoch that takes it whole, and its first words once if the budget ends in it.

    Those first words are joined by single spaces. Rows that repeat id, text and source are one document whose takes are
    added up, so the words of a source meet its target; other columns come from one of them. A document without
    words is in no mix; a null doc_id is like others; an empty table gives an empty one.
    """
    plan = _mixed(_rows(docs), **how).groupBy(F.col("row").alias("_row"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"))
    # the join has dealt and sorted the rows by the key already: no further exchange
    rows = docs.withColumn("_row", _row(F.coalesce(F.col("text"), F.lit("")))).join(plan.where("_taken > 0"), "_row").dropDuplicates(["_row"])
    full, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), F.col("_taken") % F.col("_size")
    copies = F.concat(F.array_repeat(F.col("_size"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_n", F.explode(copies))
    text = F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_n").cast("int")), " "))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  greatest(0.25::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '%$#&*|', '')))::DOUBLE / greatest(1, length(coalesce(text, '')))::DOUBLE) AS w,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) AS e FROM documents),
k AS (SELECT *, e / w AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight, source_size * 2 AS ceiling,
  1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total FROM s0),
s2 AS (SELECT *, total - coalesce(sum(ceiling) OVER (ORDER BY ceiling::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS room0,
  sum(weight) OVER (ORDER BY ceiling::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_left FROM s1),
s3 AS (SELECT *, room0 * weight <= ceiling * weight_left AS free FROM s2),
s4 AS (SELECT *, first_value(CASE WHEN free THEN room0 / weight_left END IGNORE NULLS) OVER (ORDER BY ceiling::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM s3),
s AS (SELECT source, source_size, CASE WHEN free THEN level * weight ELSE ceiling::DOUBLE END AS target FROM s4),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS whole FROM s),
j AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.whole, floor(p.target)::BIGINT - p.whole * p.source_size AS room,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, room - before)))::BIGINT AS taken FROM j
"""
