"""Hybrid retrieval: rank fusion, filters from the question, per-entity interleaving and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import text_index
from lodestone.operators.lexical import TF, bm25, questions, top
from lodestone.registry import query, table

POOL, CONSTANT, DEPTH = 50, 60, 5
# How a text names a fiscal year, and a quarter with its year.
YEAR, QUARTER = r"(?i)\b(?:fy\s?|fiscal\s+(?:year\s+)?|q[1-4]\s*)(\d{4})\b", r"(?i)\bq([1-4])\s*(?:of\s+)?(?:fy|fiscal\s*(?:year\s*)?)?\s*\d{4}\b"


def overlap(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """A second lexical list: documents by how many of a question's distinct terms they hold."""
    return text_index.search(index, asked, k, overlap=True)


def fuse(lists: list[DataFrame], k: int, constant: int = CONSTANT) -> DataFrame:
    """Reciprocal rank fusion: sums 1 / (constant + rank); ties to the earlier list, then its rank."""
    rows = [x.select("qid", "doc_id", F.lit(i).alias("source_no"), "rank") for i, x in enumerate(lists)]
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")
    fused = every.groupBy("qid", "doc_id").agg(score, F.min(F.struct("source_no", "rank")).alias("first"), F.sort_array(F.collect_set("source_no")).alias("sources"))
    return top(fused.drop("rank"), k, F.desc("score"), F.col("first"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    index = text_index.built(docs)
    return fuse([text_index.search(index, asked, POOL), overlap(index, asked, POOL)], DEPTH)


RRF = f"""{TF}, o AS (SELECT qt.qid, p.doc_id, row_number() OVER (PARTITION BY qt.qid ORDER BY count(*) DESC, p.doc_id) AS rank FROM p JOIN qt USING (term) GROUP BY qt.qid, p.doc_id),
u AS (SELECT qid, doc_id, 0 AS src, rank FROM bm WHERE rank <= 50 UNION ALL SELECT qid, doc_id, 1, rank FROM o WHERE rank <= 50),
g AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(src * 1000 + rank) AS first, list_sort(list(src)) AS sources FROM u GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first)::INT AS rank FROM g)"""


@query(f"WITH {RRF} SELECT qid, doc_id, score, rank FROM fu WHERE rank <= 5")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("qid", "doc_id", "score", "rank")


@query(f"WITH {RRF} SELECT qid, src::INT AS source_no, count(*) AS n FROM (SELECT qid, unnest(sources) AS src FROM fu WHERE rank <= 5) GROUP BY ALL")
def fusion_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("qid", F.explode("sources").alias("source_no")).groupBy("qid", "source_no").agg(F.count(F.lit(1)).alias("n"))


def facets(question: Column) -> list[Column]:
    """Year and quarter that a text names, null where it names none."""
    got = lambda pattern: F.nullif(F.regexp_extract(question, pattern, 1), F.lit("")).cast("int")
    return [got(YEAR).alias("fiscal_year"), got(QUARTER).alias("fiscal_quarter")]


FACETS = f"nullif(regexp_extract(text, '{YEAR}', 1), '')::INT AS fiscal_year, nullif(regexp_extract(text, '{QUARTER}', 1), '')::INT AS fiscal_quarter"


@query(f"SELECT doc_id, fiscal_year::VARCHAR AS fiscal_year, fiscal_quarter::VARCHAR AS fiscal_quarter FROM (SELECT doc_id, {FACETS} FROM documents)")
def query_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *facets(F.col("text")))
    return rows.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("fiscal_year", "fiscal_quarter")])


@query(f"WITH f AS (SELECT doc_id, source, {FACETS} FROM documents) SELECT doc_id, source, CASE WHEN fiscal_quarter IS NOT NULL THEN 'FY' || fiscal_year || ' Q' || fiscal_quarter END AS period_label FROM f WHERE fiscal_year IS NOT NULL")
def inferred_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period goes into the filter only if a quarter is named."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", *facets(F.col("text"))).where("fiscal_year IS NOT NULL")
    label = F.when(F.col("fiscal_quarter").isNotNull(), F.concat(F.lit("FY"), "fiscal_year", F.lit(" Q"), "fiscal_quarter"))
    return rows.select("doc_id", "source", label.alias("period_label"))


@query(f"WITH f AS (SELECT doc_id, source, text, {FACETS} FROM documents) SELECT doc_id, md5(concat_ws(' ', text, source, 'fy' || fiscal_year, 'q' || fiscal_quarter)) AS digest FROM f")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text with the corpus's own spelling of what it names."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text", *facets(F.col("text")))
    extra = ["source", F.concat(F.lit("fy"), "fiscal_year"), F.concat(F.lit("q"), "fiscal_quarter")]
    return rows.select("doc_id", F.md5(F.concat_ws(" ", "text", *extra)).alias("digest"))


@query(
    f"WITH {TF}, f AS (SELECT m.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM m JOIN documents d USING (doc_id) WHERE d.lang = 'es'), "
    "a AS (SELECT qid, doc_id, round(score / best, 6) AS score, rank, true AS filtered FROM f WHERE rank <= 5), b AS (SELECT qid, doc_id, round(score / best, 6) AS score, rank, false AS filtered FROM bm WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM a)) "
    "SELECT * FROM a UNION ALL SELECT * FROM b"
)
def filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered list; a question that it leaves empty gets its unfiltered list, in one plan."""
    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    return fallback(docs, asked, DEPTH, F.col("lang") == "es")


def fallback(docs: DataFrame, asked: DataFrame, k: int, where: Column) -> DataFrame:
    """qid, doc_id, score, rank, filtered: one scoring gives the k best inside of the filter and outside of it; both together hold the k best of all."""
    index = text_index.built(docs, F.coalesce(where, F.lit(False)))
    own = Window.partitionBy("qid")
    rows = text_index.search(index, asked, k).withColumn("best", F.max("score").over(own)).withColumn("filtered", F.max(F.col("label") == "true").over(own))
    rows = rows.where(~F.col("filtered") | (F.col("label") == "true")).drop("rank")
    return top(rows, k, F.desc("score"), F.col("doc_id")).select("qid", "doc_id", F.round(F.col("score") / F.col("best"), 6).alias("score"), "rank", "filtered")


@query(
    f"WITH {TF}, x AS (SELECT m.qid, m.doc_id, d.source, row_number() OVER (PARTITION BY m.qid, d.source ORDER BY score DESC, m.doc_id) AS position FROM m JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position, source)::INT AS rank FROM x WHERE position <= 5) SELECT qid, doc_id, source, rank FROM r WHERE rank <= 5"
)
def interleave_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranked list for each source of the table, dealt in turn: first of each, second of each, and so on."""
    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    index = text_index.built(docs, F.col("source"))
    rows = text_index.search(index, asked, DEPTH).where("label IS NOT NULL").withColumnsRenamed({"rank": "position", "label": "source"})
    return top(rows, DEPTH, F.col("position"), F.col("source")).select("qid", "doc_id", "source", "rank")


def grade(reply: Column) -> Column:
    """The first number from 0 to 10 on the last line of a reply; 0 without one."""
    last = F.element_at(F.split(F.trim(reply), "\n"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(last, r"\b(10|[0-9])\b", 1), F.lit("")).cast("int"), F.lit(0))


@query(
    f"WITH {TF}, g AS (SELECT qid, doc_id, bm.rank AS inner_rank, coalesce(nullif(regexp_extract('Grade:' || chr(10) || (d.n_chars % 11)::VARCHAR, '\\b(10|[0-9])\\b', 1), '')::INT, 0) AS grade FROM bm JOIN documents d USING (doc_id) WHERE bm.rank <= 20), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, inner_rank)::INT AS rank FROM g) SELECT qid, doc_id, grade / 10.0::DOUBLE AS score, rank FROM r WHERE rank <= 5"
)
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool re-ordered by a judge's grade; here a fixed stand-in writes the reply that is parsed."""
    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    pool = bm25(docs, asked, 20).withColumnRenamed("rank", "inner_rank").join(docs.select("doc_id", "n_chars"), "doc_id")
    reply = F.concat(F.lit("Grade:\n"), (F.col("n_chars") % 11).cast("string"))
    graded = pool.select("qid", "doc_id", "inner_rank", grade(reply).alias("grade"))
    return top(graded, DEPTH, F.desc("grade"), F.col("inner_rank")).select("qid", "doc_id", (F.col("grade") / 10.0).alias("score"), "rank")
