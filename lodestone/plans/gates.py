"""Refusal gates before and after retrieval, and the metrics of abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import text_index
from lodestone.operators.lexical import TF, questions
from lodestone.plans.evaluation import GOLD, gold_spans
from lodestone.registry import query, table
from lodestone.storage import landed

THRESHOLDS = (0.0, 2.0, 4.0, 8.0, 12.0, 16.0, 20.0, 30.0)


def corpus_scope_of(docs: DataFrame) -> DataFrame:
    """One row: known sources, languages and least and most length."""
    return docs.agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("lang")).alias("langs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def found_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """qid, doc_id, score, rank of every benchmark question."""
    index = text_index.built(table(spark, sf_dir, "documents"))
    return text_index.search(index, questions(table(spark, sf_dir, "benchmark")), k)


def best_scores(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """qid, best score (null without a result), whether the question has gold in the corpus."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    best = (found_documents(spark, sf_dir, 1) if found is None else found).where("rank = 1").select("qid", F.col("score").alias("best"))
    gold = gold_spans(docs, bench).select("qid").distinct().withColumn("answerable", F.lit(True))
    rows = bench.select(F.col("item_id").alias("qid")).join(best, "qid", "left").join(gold, "qid", "left")
    return rows.select("qid", "best", F.coalesce("answerable", F.lit(False)).alias("answerable"))


def abstention(refused: Column, answerable: Column) -> list[Column]:
    """Precision, recall and F1 of refusing what can't be answered, and the share of the answerable that is answered; 0 where undefined."""
    n = lambda c: F.count_if(c).cast("double")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    right = n(refused & ~answerable)
    precision, recall = safe(right, n(refused)), safe(right, n(~answerable))
    f1 = safe(2 * precision * recall, precision + recall)
    kept = safe(n(answerable & ~refused), n(answerable))
    return [F.round(c, 6).alias(a) for c, a in ((precision, "precision"), (recall, "recall"), (f1, "f1"), (kept, "coverage"))]


BEST = f"{TF}, {GOLD}, bs AS (SELECT b.item_id AS qid, (SELECT max(best) FROM m WHERE m.qid = b.item_id) AS best, b.item_id IN (SELECT qid FROM gs) AS answerable FROM benchmark b)"
METRICS = """yy AS (SELECT {g} count(*) FILTER (refused AND NOT answerable)::DOUBLE AS tp, count(*) FILTER (refused)::DOUBLE AS r, count(*) FILTER (NOT answerable)::DOUBLE AS u, count(*) FILTER (answerable AND NOT refused)::DOUBLE AS ok, count(*) FILTER (answerable)::DOUBLE AS a FROM x {by}),
zz AS (SELECT *, CASE WHEN r > 0 THEN tp / r ELSE 0 END AS pr, CASE WHEN u > 0 THEN tp / u ELSE 0 END AS re FROM yy)
SELECT {g} round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(CASE WHEN a > 0 THEN ok / a ELSE 0 END, 6) AS coverage FROM zz"""


@query("SELECT array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def corpus_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus_scope_of(table(spark, sf_dir, "documents"))
    return scope.select(F.array_join("sources", ",").alias("sources"), F.array_join("langs", ",").alias("langs"), "least", "most")


@query(
    r"WITH s AS (SELECT list(DISTINCT source) AS sources, max(n_chars) AS most FROM documents) SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(weather|stock price)\b') THEN 'off_topic' WHEN length(text) > most THEN 'too_long' "
    r"WHEN regexp_matches(text, '\bsrc\d+\b') AND NOT list_contains(sources, regexp_extract(text, '\bsrc\d+\b')) THEN 'unknown_company' END AS reason FROM conversations, s WHERE role = 'user'"
)
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a question is refused before retrieval; the scope is one row, broadcast."""
    scope = corpus_scope_of(table(spark, sf_dir, "documents")).select("sources", "most")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").join(F.broadcast(scope))
    named = F.regexp_extract("text", r"\bsrc\d+\b", 0)
    reason = (
        F.when(F.lower("text").rlike(r"\b(weather|stock price)\b"), "off_topic")
        .when(F.length("text") > F.col("most"), "too_long")
        .when((named != "") & ~F.array_contains(F.col("sources"), named), "unknown_company")
    )
    return rows.select("conv_id", "turn", reason.alias("reason"))


@query(f"WITH {BEST}, t AS (SELECT qid, list(doc_id ORDER BY rank) AS ids FROM bm WHERE rank <= 3 GROUP BY qid) SELECT qid, CASE WHEN best IS NULL OR best < 12 THEN 'low_confidence' END AS reason, coalesce(array_to_string(ids, ','), '') AS closest FROM bs LEFT JOIN t USING (qid)")
def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too low a best score refuses the question; its three closest documents go with the answer."""
    bench, found = table(spark, sf_dir, "benchmark"), found_documents(spark, sf_dir, 3)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    per = found.groupBy("qid").agg(F.max("score").alias("best"), F.array_join(F.transform(ordered, lambda x: x.doc_id.cast("string")), ",").alias("closest"))
    rows = bench.select(F.col("item_id").alias("qid")).join(per, "qid", "left")
    reason = F.when(F.col("best").isNull() | (F.col("best") < 12), "low_confidence").alias("reason")
    return rows.select("qid", reason, F.coalesce("closest", F.lit("")).alias("closest"))


@query(f"WITH {BEST}, x AS (SELECT answerable, best IS NULL OR best < 12 AS refused FROM bs), {METRICS.format(g='', by='')}")
def abstention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = best_scores(spark, sf_dir)
    return rows.agg(*abstention(F.col("best").isNull() | (F.col("best") < 12), F.col("answerable")))


@query(f"WITH {BEST}, x AS (SELECT t.threshold, answerable, best IS NULL OR best < t.threshold AS refused FROM bs, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) t(threshold)), {METRICS.format(g='threshold,', by='GROUP BY threshold')}")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = best_scores(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    return rows.groupBy("threshold").agg(*abstention(F.col("best").isNull() | (F.col("best") < F.col("threshold")), F.col("answerable")))


@query(f"WITH {BEST} SELECT CASE WHEN best IS NULL THEN 'no_result' WHEN best < 12 THEN 'low_confidence' ELSE 'answered' END AS reason, count(*) AS n, count(*) FILTER (NOT answerable AND best >= 12) AS leaks FROM bs GROUP BY 1")
def refusal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("best").isNull(), "no_result").when(F.col("best") < 12, "low_confidence").otherwise("answered").alias("reason")
    leak = F.count_if(~F.col("answerable") & (F.col("best") >= 12)).alias("leaks")
    return best_scores(spark, sf_dir).groupBy(reason).agg(F.count(F.lit(1)).alias("n"), leak)


@query(
    f"WITH {BEST}, t AS (SELECT bm.qid, bm.doc_id, CASE WHEN contains(d.text, b.text) THEN 'answered' ELSE 'insufficient_evidence' END AS verdict FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bm.qid WHERE bm.rank = 1) "
    "SELECT bs.qid, CASE WHEN best IS NULL OR best < 12 THEN 'low_confidence' ELSE t.verdict END AS outcome FROM bs LEFT JOIN t USING (qid)"
)
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole question plan: retrieval, its gate, an answer from the best passage (a stand-in for a model), the answer's gate."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = landed(found_documents(spark, sf_dir, 1), "found")
    gate = best_scores(spark, sf_dir, found)
    first = found.select("qid", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    first = first.join(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("quote")), "qid")
    answer = first.select("qid", F.when(F.col("text").contains(F.col("quote")), "answered").otherwise("insufficient_evidence").alias("verdict"))
    low = F.col("best").isNull() | (F.col("best") < 12)
    return gate.join(answer, "qid", "left").select("qid", F.when(low, "low_confidence").otherwise(F.col("verdict")).alias("outcome"))
