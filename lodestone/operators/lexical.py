"""BM25 over documents: postings, inverse document frequencies and ranked search for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import text_index
from lodestone.operators.text_index import EPSILON
from lodestone.registry import query, table

#: Results per question.
DEPTH = 5


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl (tokens in the document)."""
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("toks"))
    # the length is taken below the explode, or each token's row would carry the whole list
    rows = rows.select("doc_id", "toks", F.size("toks").cast("long").alias("dl")).select("doc_id", "dl", F.explode("toks").alias("term"))
    return rows.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def idf(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf: negative values become EPSILON times the mean of all."""
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    raw = df.withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def questions(benchmark: DataFrame) -> DataFrame:
    """Whole benchmark passages as questions."""
    return benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each question, ranked from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, asked: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """qid, doc_id, score, rank: scores as shares of the question's best; a filter comes after scoring, so it may leave the best out."""
    index = text_index.built(docs, None if where is None else F.coalesce(where, F.lit(False)))
    rows = text_index.search(index, asked, k).withColumn("best", F.max("score").over(Window.partitionBy("qid")))
    if where is not None:
        rows = rows.where("label = 'true'")
    return rows.select("qid", "doc_id", F.round(F.col("score") / F.col("best"), 6).alias("score"), "rank")


TOKENS = r"'[a-z]+\d[\w.]*|\d[\d,]*(?:\.\d+)?|[a-z]+'"
TF = f"""t0 AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), {TOKENS}) AS toks FROM documents),
dl AS (SELECT doc_id, source, lang, len(toks) AS dl FROM t0), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t0) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), d0 AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM p, n GROUP BY term),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END AS idf FROM d0),
q AS (SELECT item_id AS qid, text AS question FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest(regexp_extract_all(lower(question), {TOKENS})) AS term FROM q) GROUP BY ALL),
s AS (SELECT qt.qid, p.doc_id, round(sum(qn * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl))), 9) AS score
  FROM p JOIN qt USING (term) JOIN i USING (term) JOIN dl USING (doc_id), n GROUP BY ALL),
m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM s WHERE score > 0),
bm AS (SELECT qid, doc_id, score, best, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM m)"""


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {TOKENS}), ' ') AS tokens FROM documents")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return idf(postings(docs), docs).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TF} SELECT qid, doc_id, round(score / best, 6) AS score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark")), DEPTH)


@query(
    f"WITH {TF}, f AS (SELECT m.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, m.doc_id)::INT AS rank FROM m JOIN documents d USING (doc_id) WHERE d.lang = 'en') "
    "SELECT qid, doc_id, round(score / best, 6) AS score, rank FROM f WHERE rank <= 5"
)
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark")), DEPTH, F.col("lang") == "en")
