"""Evaluation of generated answers: gold context, a record for each answer, rates that are absent where nothing was measured, and the answer gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import figures as N
from lodestone.plans.answers import VERDICTS, order_answers, verify
from lodestone.registry import query, table


def gold_context(chunks: DataFrame, evidence: DataFrame, k: int, min_chars: int = 1, min_fraction: float = 0.5) -> DataFrame:
    """qid, rank, chunk_id: the first k chunks (chunk_id, doc_id, start, end) in corpus order that cover a gold span (qid, doc_id, start, end).

    A chunk covers a span if it holds min_chars of its characters and min_fraction of it. The join is on the document, the interval is a
    condition on what meets there; a chunk that covers several spans of a question counts once.
    """
    spans = evidence.select("qid", F.col("doc_id").alias("of"), F.col("start").alias("a"), F.col("end").alias("b"))
    shared = F.least("end", "b") - F.greatest("start", "a")
    near = chunks.join(spans, (F.col("doc_id") == F.col("of")) & (F.col("start") < F.col("b")) & (F.col("end") > F.col("a")))
    good = near.where((shared >= min_chars) & (shared >= min_fraction * (F.col("b") - F.col("a")))).select("qid", "doc_id", "start", "end", "chunk_id").distinct()
    own = Window.partitionBy("qid").orderBy("doc_id", "start", "end", "chunk_id")
    return good.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id")


def gold_figures_present(gold: Column, answer: Column) -> Column:
    """Whether an answer states all figures of the gold answer, by their absolute value to four places; of a gold answer without figures, its words."""
    whole = lambda text: F.transform(N.amounts(F.coalesce(text, F.lit(""))), lambda a: F.round(a["value"] * a["scale"], 4))
    words = F.lower(F.regexp_replace(F.coalesce(gold, F.lit("")), r"\A[. ]+|[. ]+\z", ""))
    return F.when(F.size(whole(gold)) > 0, F.size(F.array_except(whole(gold), whole(answer))) == 0).otherwise(F.contains(F.lower(F.coalesce(answer, F.lit(""))), words))


def results(given: DataFrame, passages: DataFrame, asked: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row for each answer (answer_id, answer) to a question (answer_id, type, gold_answer): what the verifier says of it, in numbers.

    judged has answer_id, faithfulness and correctness; without it, or without a row in it, these are null.
    """
    records = verify(given, passages).join(given.select("answer_id", "answer"), "answer_id").join(asked, "answer_id")
    none = [F.lit(None).cast("double").alias("faithfulness"), F.lit(None).cast("string").alias("correctness")]
    records = records.join(judged, "answer_id", "left") if judged is not None else records.select("*", *none)
    n = lambda c: F.size(c).cast("long").alias(c if isinstance(c, str) else None)
    return records.select(
        "answer_id", "type", "insufficient", n("invalid_tags"), n("unsupported"), n("derived"), F.size(F.filter("derived", lambda d: d["verified"])).cast("long").alias("derived_verified"),
        n("calculations"), F.size(F.filter("calculations", lambda c: c["verified"])).cast("long").alias("calculations_verified"), F.transform("calculations", lambda c: c["reason"]).alias("reasons"),
        "cited_sentences", "fully_grounded", gold_figures_present(F.col("gold_answer"), F.col("answer")).alias("gold_figures_present"), "faithfulness", "correctness",
    )


def rates(rows: DataFrame) -> DataFrame:
    """Rates of results() over all answers (type null) and for each type, in one pass.

    All but insufficient_evidence are of the answers that were given (of one, if there are none). Rates of derived figures, of calculations and of
    the judge are null, not 0, where none was made. Null types are a group named `none`.
    """
    answered = ~F.col("insufficient")
    share = lambda c: F.count_if(answered & c) / F.greatest(F.count_if(answered), F.lit(1))
    total = lambda c: F.sum(F.when(answered, F.col(c)).otherwise(0))
    per = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0)))
    judged = answered & F.col("faithfulness").isNotNull()
    scored = judged & F.col("correctness").isNotNull()
    found = rows.withColumn("type", F.coalesce("type", F.lit("none"))).groupingSets([[], ["type"]], "type").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.col("insufficient").cast("int")).alias("insufficient_evidence"),
        share(F.col("invalid_tags") == 0).alias("citation_resolution"), share(F.col("unsupported") == 0).alias("all_sentences_cited"), share(F.col("derived") == 0).alias("figures_verified"),
        per(F.count_if(answered & (F.col("derived") == F.col("derived_verified"))), F.count_if(answered)).alias("figures_accounted"),
        per(total("derived_verified"), total("derived")).alias("derived_verified"), per(total("calculations_verified"), total("calculations")).alias("calculations_verified"),
        share(F.col("fully_grounded")).alias("fully_grounded"), share(F.col("gold_figures_present")).alias("gold_figures_present"),
        per(F.sum(F.when(judged, F.col("faithfulness"))), F.count_if(judged)).alias("faithfulness"),
        per(F.count_if(scored & (F.col("correctness") == "correct")), F.count_if(scored)).alias("correct"), per(F.count_if(scored & F.col("correctness").isin("correct", "partial")), F.count_if(scored)).alias("correct_or_partial"),
    )
    return found


def failures(rows: DataFrame) -> DataFrame:
    """reason, n: why calculations failed, the most frequent first, then by name."""
    reasons = rows.select(F.explode("reasons").alias("reason")).where("reason <> ''")
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def answer_check(rows: DataFrame) -> DataFrame:
    """answer_id, reason: why an answer is not shown after it was made; null for one that is."""
    reason = F.when(F.col("insufficient"), "insufficient_evidence").when(F.col("cited_sentences") == 0, "verification_failed")
    return rows.select("answer_id", reason.alias("reason"))


TYPES = ("lookup", "derived", "cross_period")


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers about orders, some without their tags, their passages, and questions with a type and the right sum."""
    given, passages = order_answers(spark, sf_dir)
    bare = F.when(F.col("answer_id") % 10 == 5, N.strip_tags(F.split("answer", "\n")[0])).otherwise(F.col("answer"))
    first = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("answer_id"))
    of = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_extendedprice")))
    right = first.agg(F.format_number(of(1) + of(2), 2).alias("sum")).where("sum IS NOT NULL")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("answer_id") % 3 + 1).cast("int"))
    asked = right.select("answer_id", kind.alias("type"), F.concat(F.lit("It is $"), "sum").alias("gold_answer"))
    return given.withColumn("answer", bare), passages, asked


_K = f"{VERDICTS}, g AS (SELECT answer_id, ['lookup', 'derived', 'cross_period'][(answer_id % 3 + 1)::INT] AS type, CASE WHEN answer_id % 10 = 5 THEN 5 ELSE k END AS k FROM v)"


@query(
    f"""WITH {_K}, r AS (SELECT coalesce(type, '(all)') AS type, count(*) AS questions, avg((k = 4)::INT) AS insufficient_evidence, count(*) FILTER (k <> 4)::DOUBLE AS n, count(*) FILTER (k = 0) AS good, count(*) FILTER (k = 1) AS wrong, count(*) FILTER (k = 3) AS lost, count(*) FILTER (k = 5) AS bare, count(*) FILTER (k IN (0, 1, 2, 3)) AS made FROM g GROUP BY GROUPING SETS ((), (type)))
SELECT type, questions, round(insufficient_evidence, 6) AS insufficient_evidence, round((n - lost) / n, 6) AS citation_resolution, round((n - bare) / n, 6) AS all_sentences_cited, round(bare / n, 6) AS figures_verified, round((good + bare) / n, 6) AS figures_accounted, round(good / made::DOUBLE, 6) AS derived_verified,
round(good / made::DOUBLE, 6) AS calculations_verified, round(good / n, 6) AS fully_grounded, round((n - wrong) / n, 6) AS gold_figures_present, NULL::DOUBLE AS faithfulness FROM r"""
)
def generation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of answers about orders, verified against their passages, by the type of question; no judge, so no rate of it."""
    found = rates(results(*_cases(spark, sf_dir))).withColumn("type", F.coalesce("type", F.lit("(all)")))
    kept = ("insufficient_evidence", "citation_resolution", "all_sentences_cited", "figures_verified", "figures_accounted", "derived_verified", "calculations_verified", "fully_grounded", "gold_figures_present", "faithfulness")
    return found.select("type", "questions", *[F.round(c, 6).alias(c) for c in kept])


@query(f"WITH {_K} SELECT CASE k WHEN 4 THEN 'insufficient_evidence' WHEN 5 THEN 'verification_failed' ELSE 'answered' END AS outcome, count(*) AS n FROM g GROUP BY 1")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate after generation lets through."""
    given, passages, _ = _cases(spark, sf_dir)
    return answer_check(verify(given, passages)).groupBy(F.coalesce("reason", F.lit("answered")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
