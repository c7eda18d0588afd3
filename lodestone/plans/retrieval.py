"""Retrieval strategies by name over one corpus: dense, lexical, and both fused, with the filters that questions imply or without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, text_index
from lodestone.operators.fusion import POOL, fuse
from lodestone.operators.lexical import TF, questions
from lodestone.registry import query, table

# The names of strategies.
STRATEGIES = ("dense", "bm25", "hybrid")


def dense_list(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k documents (vectors: doc_id, embedding) nearest to each question (qid, question, embedding) by cosine; a blank question has none."""
    rows = vectors.select(F.col("doc_id").alias("vec_id"), F.lit(None).cast("int").alias("label"), "embedding")
    given = asked.where(F.trim("question") != "").select(F.col("qid").alias("vec_id"), F.lit(None).cast("int").alias("label"), "embedding")
    return dense.nearest(rows, k, asked=given).select("qid", F.col("vec_id").alias("doc_id"), "score", "rank")


def retrieve(strategy: str, docs: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank of a strategy; both lists of a hybrid are POOL long, and a question without a vector or without known words has one of them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if strategy == "dense":
        return dense_list(vectors, asked, k)
    index = text_index.built(docs)
    if strategy == "bm25":
        return text_index.search(index, asked, k).select("qid", "doc_id", "score", "rank")
    lists = [dense_list(vectors, asked, POOL), text_index.search(index, asked, POOL)]
    return fuse(lists, k).select("qid", "doc_id", "score", "rank")


@query(
    f"""WITH {TF}, e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), dn AS (SELECT qe.vec_id AS qid, de.vec_id AS doc_id, row_number() OVER (PARTITION BY qe.vec_id ORDER BY round(list_cosine_similarity(qe.v, de.v), 6) DESC, de.vec_id) AS rank
FROM e qe JOIN benchmark b ON b.item_id = qe.vec_id JOIN e de ON true JOIN documents d ON d.doc_id = de.vec_id WHERE trim(b.text) <> ''),
u AS (SELECT qid, doc_id, 0 AS src, rank FROM dn WHERE rank <= 50 UNION ALL SELECT qid, doc_id, 1, rank FROM bm WHERE rank <= 50), g AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(src * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first)::INT AS rank FROM g QUALIFY rank <= 5"""
)
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions against documents by vectors and words; the vectors of both are the rows of `embeddings` with their ids."""
    vectors, docs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), table(spark, sf_dir, "documents")
    of_docs = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "doc_id")
    asked = questions(table(spark, sf_dir, "benchmark")).join(vectors.withColumnRenamed("vec_id", "qid"), "qid", "left")
    return retrieve("hybrid", docs, of_docs, asked, 5)
