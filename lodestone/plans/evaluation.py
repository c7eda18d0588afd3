"""Evaluation: gold spans, relevance by overlap, ranks, recall, MRR, nDCG, near misses and regression gates."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.lexical import TF, bm25, questions
from lodestone.operators.parsing import BLOCKS, HEADS, LINES, sections, slices, spread
from lodestone.registry import query, table

DEPTH, KS = 10, (1, 3, 5, 10)


#: Bytes of passages that are searched for at once.
PASSAGES = 1 << 20


def occurrences(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Every place where a passage (qid, passage) stands verbatim in a text: qid, doc_id, start, end, in code points.

    All passages are looked for in one walk over each text, by an automaton; they go to the tasks in parts of PASSAGES bytes, so nothing is
    joined or shuffled. Overlapping occurrences count, equal passages of several questions too; null and empty ones stand nowhere.
    """
    spark = docs.sparkSession
    asked = passages.where(F.length("passage") > 0)
    n = max(1, -(-(asked.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) // PASSAGES))
    qid, doc_id = dict(passages.dtypes)["qid"], dict(docs.dtypes)["doc_id"]
    rows = spread(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL"))
    found: DataFrame | None = None
    for i in range(n):
        of: dict[str, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("passage"), F.lit(n)) == i).select("qid", "passage").collect():  # bounded: dealt by a hash
            of.setdefault(r.passage, []).append(r.qid)
        sent = spark.sparkContext.broadcast(of)

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for passage, qids in sent.value.items():
                automaton.add_word(passage, (len(passage), qids))
            automaton.make_automaton()
            for batch in slices(batches):
                out: list[tuple] = []
                if len(automaton):
                    for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                        out += [(q, doc, end + 1 - size, end + 1) for end, (size, qids) in automaton.iter(text) for q in qids]
                kinds = (kind_of[0], batch["doc_id"].type, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["qid", "doc_id", "start", "end"])

        kind_of = [to_arrow_type(passages.schema["qid"].dataType)]
        one = rows.mapInArrow(each, f"qid {qid}, doc_id {doc_id}, start long, end long")
        found = one if found is None else found.unionByName(one)
    return found


def gold_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where each benchmark passage first stands in each document: qid, doc_id, start, end."""
    places = occurrences(docs, benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("passage")))
    return places.groupBy("qid", "doc_id").agg(F.min(F.struct("start", "end")).alias("at")).select("qid", "doc_id", "at.*")


GOLD = "gs AS (SELECT b.item_id AS qid, d.doc_id, (strpos(d.text, b.text) - 1)::BIGINT AS start, (strpos(d.text, b.text) - 1 + length(b.text))::BIGINT AS \"end\" FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question: lang group of its gold, first relevant rank, relevant in list and corpus, first same-source rank."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = gold_spans(docs, bench).join(docs.select("doc_id", "source", "lang"), "doc_id")
    per = gold.groupBy("qid").agg(F.count_distinct("doc_id").alias("in_corpus"), F.min("lang").alias("lang"), F.collect_set("source").alias("sources"))
    found = bm25(docs, questions(bench), DEPTH).join(docs.select("doc_id", "source"), "doc_id")
    marks = found.join(gold.select("qid", "doc_id", F.lit(True).alias("hit")).distinct(), ["qid", "doc_id"], "left").join(per, "qid")
    ranks = marks.groupBy("qid").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.count_if("hit").alias("in_list"),
        F.min(F.when(F.array_contains("sources", F.col("source")), F.col("rank"))).alias("source_rank"),
        F.sum(F.when(F.col("hit") & (F.col("rank") <= 5), 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
    )
    zero = F.coalesce("in_list", F.lit(0).cast("long")).alias("in_list")
    return per.join(ranks, "qid", "left").select("qid", "lang", "in_corpus", "first_rank", zero, "source_rank", F.coalesce("dcg", F.lit(0.0)).alias("dcg"))


RESULTS = f"""{TF}, {GOLD}, gl AS (SELECT DISTINCT gs.qid, gs.doc_id, d.source, d.lang FROM gs JOIN documents d USING (doc_id)),
pq AS (SELECT qid, count(DISTINCT doc_id) AS in_corpus, min(lang) AS lang FROM gl GROUP BY qid),
fd AS (SELECT bm.qid, bm.doc_id, bm.rank, EXISTS (SELECT 1 FROM gl WHERE gl.qid = bm.qid AND gl.doc_id = bm.doc_id) AS hit, EXISTS (SELECT 1 FROM gl WHERE gl.qid = bm.qid AND gl.source = d.source) AS near FROM bm JOIN documents d USING (doc_id) WHERE bm.rank <= 10),
rk AS (SELECT qid, min(rank) FILTER (hit) AS first_rank, count(*) FILTER (hit) AS in_list, min(rank) FILTER (near) AS source_rank, sum(CASE WHEN hit AND rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg FROM fd GROUP BY qid),
qr AS (SELECT pq.qid, pq.lang, pq.in_corpus, rk.first_rank, coalesce(rk.in_list, 0) AS in_list, rk.source_rank, coalesce(rk.dcg, 0) AS dcg FROM pq LEFT JOIN rk USING (qid))"""


@query(f'WITH {GOLD} SELECT qid, doc_id, start, "end" FROM gs')
def gold_span_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()


OVERLAP = f"""WITH {LINES}, {HEADS}, {BLOCKS}, {GOLD}, ov AS (SELECT gs.qid, b.doc_id, b.block, greatest(0, least(b."end", gs."end") - greatest(b.start, gs.start)) AS chars, gs."end" - gs.start AS size FROM gs JOIN b USING (doc_id))"""


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each section shares with each gold span of its document: an equi-join with an interval condition."""
    docs = table(spark, sf_dir, "documents")
    gold = gold_spans(docs, table(spark, sf_dir, "benchmark")).distinct().select("qid", "doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    rows = sections(docs).join(gold, "doc_id")
    chars = F.greatest(F.lit(0), F.least("end", "b") - F.greatest("start", "a"))
    return rows.select("qid", "doc_id", "block", chars.alias("chars"), (F.col("b") - F.col("a")).alias("size"))


@query(f"{OVERLAP} SELECT qid, doc_id, block, chars FROM ov WHERE chars > 0")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_overlaps(spark, sf_dir).where("chars > 0").select("qid", "doc_id", "block", "chars")


@query(f"{OVERLAP} SELECT i.item_id AS qid, count(DISTINCT ov.doc_id || '-' || ov.block) AS relevant FROM benchmark i LEFT JOIN ov ON ov.qid = i.item_id AND ov.chars >= 10 AND ov.chars >= 0.5::DOUBLE * ov.size GROUP BY i.item_id")
def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_overlaps(spark, sf_dir).where((F.col("chars") >= 10) & (F.col("chars") >= 0.5 * F.col("size")))
    counts = rows.groupBy("qid").agg(F.count_distinct("doc_id", "block").alias("relevant"))
    every = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return every.join(counts, "qid", "left").select("qid", F.coalesce("relevant", F.lit(0).cast("long")).alias("relevant"))


@query(f"WITH {RESULTS} SELECT qid, in_corpus, coalesce(first_rank, 0)::INT AS first_rank, in_list, coalesce(source_rank, 0)::INT AS source_rank FROM qr")
def question_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ranks, 0 for a question that has none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return question_results(spark, sf_dir).select("qid", "in_corpus", zero("first_rank"), "in_list", zero("source_rank"))


def _within(column: str, k: int) -> object:
    return F.round(F.avg((F.coalesce(F.col(column), F.lit(1000)) <= k).cast("int")), 6)


@query(f"WITH {RESULTS} SELECT k::INT AS k, round(avg((coalesce(first_rank, 1000) <= k)::INT), 6) AS recall FROM qr, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = question_results(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    return rows.groupBy("k").agg(F.round(F.avg((F.coalesce("first_rank", F.lit(1000)) <= F.col("k")).cast("int")), 6).alias("recall"))


@query(f"WITH {RESULTS} SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM qr")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_results(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


@query(f"WITH {RESULTS} SELECT qid, round(dcg / list_sum(list_transform(range(1, least(5, in_corpus) + 1), lambda r: 1 / log2(r + 1.0::DOUBLE))), 6) AS ndcg FROM qr")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("in_corpus").cast("int"))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    return question_results(spark, sf_dir).select("qid", F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


@query(f"WITH {RESULTS} SELECT round(avg((coalesce(source_rank, 1000) <= 5)::INT), 6) AS source_rate, round(avg((coalesce(first_rank, 1000) <= 5)::INT), 6) AS chunk_rate FROM qr")
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_results(spark, sf_dir).agg(_within("source_rank", 5).alias("source_rate"), _within("first_rank", 5).alias("chunk_rate"))


@query(f"WITH {RESULTS} SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, round(avg((coalesce(first_rank, 1000) <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM qr GROUP BY GROUPING SETS ((), (lang))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = question_results(spark, sf_dir)
    both = rows.groupingSets([[], ["lang"]], "lang")
    found = both.agg(F.count(F.lit(1)).alias("n"), _within("first_rank", 5).alias("recall_5"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))
    return found.withColumn("lang", F.coalesce("lang", F.lit("(all)")))


@query(f"""WITH {GOLD}, x AS (SELECT gs.qid, gs.doc_id, CASE WHEN gs."end" + gs.qid % 2 > d.n_chars THEN 'past the end' WHEN substring(d.text, gs.start + gs.qid % 2 + 1, gs."end" - gs.start) = b.text THEN 'ok' ELSE 'drifted' END AS status FROM gs JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = gs.qid) SELECT * FROM x""")
def span_drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, every other one shifted by a character, against their quotes: what a check of a stale span reports."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = gold_spans(docs, bench).distinct().join(docs.select("doc_id", "text", "n_chars"), "doc_id")
    rows = rows.join(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("quote")), "qid")
    shift = F.col("qid") % 2
    got = F.substring("text", (F.col("start") + shift + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    status = F.when(F.col("end") + shift > F.col("n_chars"), "past the end").when(got == F.col("quote"), "ok").otherwise("drifted")
    return rows.select("qid", "doc_id", status.alias("status"))


@query(f"WITH {GOLD}, x AS (SELECT qid, doc_id, regexp_extract_all(b.text, '\\d+') AS want, regexp_extract_all(d.text, '\\d+') AS have FROM gs JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = gs.qid) SELECT qid, doc_id, len(list_filter(want, lambda w: NOT list_contains(have, w))) = 0 AS grounded FROM x")
def gold_answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every number of the answer stands in its evidence."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = gold_spans(docs, bench).distinct().join(docs.select("doc_id", "text"), "doc_id").join(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("answer")), "qid")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return rows.select("qid", "doc_id", (F.size(F.array_except(numbers(F.col("answer")), numbers(F.col("text")))) == 0).alias("grounded"))


@query(f"WITH {GOLD} SELECT CASE WHEN b.item_id IN (SELECT qid FROM gs) THEN 'lookup' ELSE 'unanswerable' END AS type, count(*) AS n FROM benchmark b GROUP BY 1")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    found = gold_spans(table(spark, sf_dir, "documents"), bench).select("qid").distinct().withColumn("found", F.lit(True))
    rows = bench.join(found, F.col("item_id") == F.col("qid"), "left")
    kind = F.when(F.col("found"), "lookup").otherwise("unanswerable").alias("type")
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RESULTS}, cur AS (SELECT 'recall_5' AS metric, avg((coalesce(first_rank, 1000) <= 5)::INT) AS v FROM qr UNION ALL SELECT 'mrr', avg(coalesce(1.0::DOUBLE / first_rank, 0)) FROM qr),
bas AS (SELECT 'recall_5' AS metric, avg((coalesce(first_rank, 1000) <= 3)::INT) AS v FROM qr UNION ALL SELECT 'mrr', avg(coalesce(1.0::DOUBLE / first_rank, 0)) + 0.1 FROM qr UNION ALL SELECT 'lost', 1.0)
SELECT bas.metric, CASE WHEN cur.v IS NULL THEN 'missing' WHEN cur.v - bas.v < -0.05 THEN 'regressed' WHEN cur.v - bas.v > 0.05 THEN 'improved' ELSE 'held' END AS status FROM bas LEFT JOIN cur USING (metric)""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics against a baseline (here derived from the same results): a missing metric fails, a new one is ignored."""
    rows = question_results(spark, sf_dir)
    rate = lambda k: F.avg((F.coalesce("first_rank", F.lit(1000)) <= k).cast("int"))
    own = rows.agg(rate(5).alias("r5"), rate(3).alias("r3"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("m"))
    now = F.array(F.struct(F.lit("recall_5").alias("metric"), F.col("r5").alias("v")), F.struct(F.lit("mrr").alias("metric"), F.col("m").alias("v")))
    then = F.array(F.struct(F.lit("recall_5").alias("metric"), F.col("r3").alias("b")), F.struct(F.lit("mrr").alias("metric"), (F.col("m") + 0.1).alias("b")), F.struct(F.lit("lost").alias("metric"), F.lit(1.0).alias("b")))
    current, baseline = own.select(F.inline(now)), own.select(F.inline(then))
    change = F.col("v") - F.col("b")
    status = F.when(F.col("v").isNull(), "missing").when(change < -0.05, "regressed").when(change > 0.05, "improved").otherwise("held")
    return baseline.join(current, "metric", "left").select("metric", status.alias("status"))
