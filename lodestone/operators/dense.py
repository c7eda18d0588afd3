"""Dense retrieval: exact neighbours by cosine or inner product, filters before or after the cut, and graphs for approximate search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph_index
from lodestone.operators.lexical import top
from lodestone.registry import query, table
from lodestone.sources.filters import compiled
from lodestone.storage import landed

#: Every vector whose id is divisible by this is a query; over-fetch of the filter that comes after the cut.
EVERY, DEPTH, OVERFETCH = 20, 5, 20


#: Queries and candidates of a block: a task makes the products of one block of each.
BLOCK = 4096


def nearest(vectors: DataFrame, k: int, cosine: bool = True, same_label: bool = False, where: dict | None = None, asked: DataFrame | None = None) -> DataFrame:
    """qid, vec_id, label, q_label, score (6 places), rank: the k best rows for each query row, ties to the smaller vec_id.

    Vectors are normalised once, both sides are dealt to blocks, and each pair of blocks is a matrix product that answers with the
    rows that can be among a query's k best. With same_label only rows of the query's label are candidates, before any score.
    The queries are the rows with every EVERY-th id, without themselves as candidates, or else those of `asked` (vec_id, label, embedding).
    A filter (see filters.compiled) is of candidates alone and reaches their scan. Vectors of unlike widths don't meet; a null vector takes no part, nor a null label with same_label (it has no equal).
    """
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "label", "embedding", F.size("embedding").alias("width"))
    filtered = vectors.where(compiled(where)).where("embedding IS NOT NULL").select("vec_id", "label", "embedding", F.size("embedding").alias("width"))
    own = asked is None
    given = rows.where(F.col("vec_id") % EVERY == 0) if own else asked.where("embedding IS NOT NULL").select("vec_id", "label", "embedding", F.size("embedding").alias("width"))
    n, asked_n = rows.count(), given.count()
    right, left = max(1, -(-n // BLOCK)), max(1, -(-(asked_n or 0) // BLOCK))
    group = [F.col("label").cast("string").alias("part")] if same_label else [F.lit("").alias("part")]
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = given.select("*", *group, deal(left).alias("l")).select("*", every(right).alias("r"))
    # both sides come from one table: a cogroup needs columns of its own on each
    others = filtered.select(*[F.col(c).alias(c) for c in rows.columns], *group, deal(right).alias("r")).select("*", every(left).alias("l"))
    kinds, keys = dict(vectors.dtypes), ["width", "part", "l", "r"]

    def unit(table: pa.Table) -> np.ndarray:
        x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) if cosine else x

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            ids, labels = ((a if a.num_rows else b)[c].slice(0, 0) for c in ("vec_id", "label"))
            return pa.table({"qid": ids, "q_label": labels, "vec_id": ids, "label": labels, "score": pa.array([], pa.float64())})
        score = unit(a) @ unit(b).T
        if own:
            score[a["vec_id"].to_numpy()[:, None] == b["vec_id"].to_numpy()[None, :]] = -np.inf
        # what rounding can make equal to the k-th stays; the order is made of rounded scores later
        floor = np.partition(score, -k, axis=1)[:, -k] - 1e-6 if b.num_rows > k else np.full(a.num_rows, -np.inf)
        q, c = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
        q_, c_ = pa.array(q), pa.array(c)
        taken = {"qid": a["vec_id"].take(q_), "q_label": a["label"].take(q_), "vec_id": b["vec_id"].take(c_), "label": b["label"].take(c_)}
        return pa.table(taken | {"score": pa.array(score[q, c])})

    schema = f"qid {kinds['vec_id']}, q_label {kinds['label']}, vec_id {kinds['vec_id']}, label {kinds['label']}, score double"
    asked, others = (graph_index.dealt(x, 2 * left * right, *keys) for x in (asked, others))
    found = asked.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(meet, schema)
    return top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col("vec_id"))


SHOWN = ["qid", "vec_id", "label", "score", "rank"]


PAIRS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
pr AS (SELECT a.vec_id AS qid, b.vec_id, b.label, a.label AS q_label, round(list_cosine_similarity(a.v, b.v), 6) AS score, round(list_inner_product(a.v, b.v), 6) AS ip FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM pr) SELECT qid, vec_id, label, score, rank FROM r WHERE rank <= 5")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), DEPTH).select(*SHOWN)


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM pr WHERE label = q_label) SELECT qid, vec_id, label, score, rank FROM r WHERE rank <= 5")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), DEPTH, same_label=True).select(*SHOWN)


RANGE = {"$and": [{"label": {"$gte": 2, "$lt": 6}}, {"$or": [{"vec_id": {"$lte": 150}}, {"label": {"$in": [3, 4]}}]}, {"label": {"$ne": 5}}]}


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM pr WHERE label >= 2 AND label < 6 AND (vec_id <= 150 OR label IN (3, 4)) AND label <> 5) SELECT qid, vec_id, label, score, rank FROM r WHERE rank <= 5")
def dense_topk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the vectors that a filter of ranges and sets lets through."""
    return nearest(table(spark, sf_dir, "embeddings"), DEPTH, where=RANGE).select(*SHOWN)


@query(f"WITH {PAIRS}, r AS (SELECT qid, vec_id, label, ip AS score, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id)::INT AS rank FROM pr) SELECT qid, vec_id, label, score, rank FROM r WHERE rank <= 5")
def flat_inner_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), DEPTH, cosine=False).select(*SHOWN)


@query(
    f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) AS r0 FROM pr), "
    "f AS (SELECT qid, vec_id, label, ip AS score, row_number() OVER (PARTITION BY qid ORDER BY r0)::INT AS rank FROM r WHERE r0 <= 100 AND label = q_label) SELECT qid, vec_id, label, score, rank FROM f WHERE rank <= 5"
)
def overfetch_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter after the cut at OVERFETCH times the depth: may return fewer than asked for."""
    pool = nearest(table(spark, sf_dir, "embeddings"), OVERFETCH * DEPTH, cosine=False).where(F.col("label").eqNullSafe(F.col("q_label")))
    return top(pool.withColumnRenamed("rank", "pool_rank"), DEPTH, F.col("pool_rank")).select("qid", "vec_id", "label", "score", "rank")


@query("SELECT label, count(*) AS n, min(len(embedding))::INT AS least_width, max(len(embedding))::INT AS most_width FROM embeddings GROUP BY label")
def vector_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.size("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("least_width"), F.max(width).alias("most_width"))


@query()
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest that small-world graphs find; see graph_recall for how many of the true ones these are."""
    vectors = table(spark, sf_dir, "embeddings")
    index = landed(graph_index.build(vectors), "graph")
    return graph_index.search(index, graph_index.every(vectors, F.col("vec_id") % EVERY == 0), DEPTH)


@query(f"SELECT count(*) FILTER (vec_id % {EVERY} = 0) AS asked, true AS nine_of_ten FROM embeddings")
def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the graphs find nine of ten true neighbours; the exact search is only the yardstick here."""
    vectors = table(spark, sf_dir, "embeddings")
    found = approximate_neighbours(spark, sf_dir).select("qid", "vec_id", F.lit(1).alias("hit"))
    true = nearest(vectors, DEPTH).select("qid", "vec_id").join(found, ["qid", "vec_id"], "left")
    return true.agg(F.count_distinct("qid").alias("asked"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_of_ten"))


@query(
    f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pr), f AS (SELECT qid, min(rank) FILTER (label = q_label) AS first FROM r WHERE rank <= 10 GROUP BY qid) "
    "SELECT count(*) AS n, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f"
)
def dense_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), 10)
    first = found.groupBy("qid").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))).alias("first"))
    within = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6).alias(f"recall_{k}")
    return first.agg(F.count(F.lit(1)).alias("n"), within(1), within(5), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
