"""Verification of answers: citations, figures, calculations, judges and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import figures as N
from lodestone.registry import query, table


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers that cite the turns before them: conv_id, turn, answer."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.concat("text", F.lit(" [c"), "turn", F.lit(", c"), F.col("turn") % 3, F.lit("] 【c9】")).alias("answer"))


ANSWERS = "an AS (SELECT conv_id, turn, text || ' [c' || turn || ', c' || (turn % 3) || '] 【c9】' AS answer FROM conversations WHERE role = 'assistant')"
TAGS = r"tg AS (SELECT conv_id, turn, answer, list_transform(flatten(list_transform(regexp_extract_all(translate(answer, '【】', '[]'), '\[(c\d+(?:\s*,\s*c\d+)*)\]', 1), lambda g: string_split(regexp_replace(g, '\s', '', 'g'), ','))), lambda t: t) AS raw FROM an), tt AS (SELECT conv_id, turn, answer, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS tags FROM tg)"


@query(f"WITH {ANSWERS}, {TAGS} SELECT conv_id, turn, array_to_string(tags, ',') AS tags, trim(regexp_replace(translate(answer, '【】', '[]'), '\\s*\\[(c\\d+(?:\\s*,\\s*c\\d+)*)\\]', '', 'g'), ' ') AS plain FROM tt")
def citation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return rows.select("conv_id", "turn", F.array_join(N.tags(F.col("answer")), ",").alias("tags"), N.strip_tags(F.col("answer")).alias("plain"))


@query(f"WITH {ANSWERS}, {TAGS}, x AS (SELECT conv_id, turn, unnest(tags) AS tag FROM tt) SELECT x.conv_id, x.turn, x.tag FROM x ANTI JOIN conversations c ON c.conv_id = x.conv_id AND 'c' || c.turn = x.tag")
def unknown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that name no passage of their conversation."""
    cited = answers(spark, sf_dir).select("conv_id", "turn", F.explode(N.tags(F.col("answer"))).alias("tag"))
    known = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("c"), "turn").alias("tag"))
    return cited.join(known, ["conv_id", "tag"], "left_anti").select("conv_id", "turn", "tag")


@query("SELECT conv_id, md5(string_agg('[c' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def passage_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged passages in rank order, a blank line between."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("tagged", F.concat(F.lit("[c"), "turn", F.lit("] "), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tagged")))
    return rows.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x.tagged), "\n\n")).alias("digest"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'), ' ') AS figures FROM documents")
def parse_figures_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.figures(F.col("text")), " ").alias("figures"))


@query(
    r"WITH f AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?')) AS figure FROM conversations), v AS (SELECT *, replace(figure, ',', '')::DOUBLE AS v FROM f) "
    "SELECT a.conv_id, a.turn, a.figure, bool_or(p.v IS NOT NULL AND (p.v = a.v OR abs(p.v - a.v) <= 0.005::DOUBLE * greatest(abs(p.v), abs(a.v)))) AS supported FROM (SELECT DISTINCT conv_id, turn, figure, v FROM v WHERE role = 'assistant') a LEFT JOIN v p ON p.conv_id = a.conv_id AND p.turn < a.turn GROUP BY ALL"
)
def figure_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier turn states a figure of an answer, within the tolerance: an equi-join with a closeness condition."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(N.figures(F.col("text"))).alias("figure"))
    rows = rows.withColumn("v", N.value(F.col("figure")))
    said = rows.where("role = 'assistant'").select("conv_id", "turn", "figure", "v").distinct()
    known = rows.select("conv_id", F.col("turn").alias("t"), F.col("v").alias("p"))
    on = (said["conv_id"] == known["conv_id"]) & (known["t"] < said["turn"])
    both = said.join(known, on, "left").drop(known["conv_id"])
    good = F.bool_or(F.coalesce(N.close(F.col("p"), F.col("v")), F.lit(False))).alias("supported")
    return both.groupBy("conv_id", "turn", "figure").agg(good)


@query()
def unsupported_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of answers, with their units, that no earlier turn of the conversation states."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", N.amounts(F.col("text")).alias("amounts"), N.caption_scale(F.col("text")).alias("caption"))
    said = rows.where("role = 'assistant'").select("conv_id", "turn", F.explode("amounts").alias("amount")).distinct()
    known = rows.where(F.size("amounts") > 0).select("conv_id", F.col("turn").alias("at"), "amounts", "caption").alias("k")
    both = said.alias("s").join(known, F.expr("s.conv_id = k.conv_id AND k.at < s.turn"), "left")
    good = F.bool_or(F.coalesce(N.stated(F.col("s.amount"), F.col("k.amounts"), F.col("k.caption")), F.lit(False))).alias("good")
    found = both.groupBy("s.conv_id", "s.turn", "s.amount").agg(good).where("NOT good")
    return found.select("conv_id", "turn", "amount.raw", "amount.value", "amount.percent", "amount.scale")


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS computed, round(l_extendedprice * (1.0::DOUBLE - l_discount) / CASE WHEN l_linenumber % 2 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN l_linenumber = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1) AS stated FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, len(list_filter([1.0::DOUBLE, 1000.0::DOUBLE, 1000000.0::DOUBLE, 1000000000.0::DOUBLE], lambda s: abs(computed / s - stated) <= 0.05000001::DOUBLE)) > 0 AS verified FROM x"
)
def calc_result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated results against computed ones: every third line is off by one, every other is in thousands."""
    rows = table(spark, sf_dir, "lineitem")
    computed = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    unit = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1000.0)).otherwise(F.lit(1.0))
    stated = F.round(computed / unit + F.when(F.col("l_linenumber") == 3, F.lit(1.0)).otherwise(F.lit(0.0)), 1)
    return rows.select("l_orderkey", "l_linenumber", N.result_matches(computed, stated, F.lit(0.05000001 - 1e-9)).alias("verified"))


REPLY = "rp AS (SELECT l.doc_id, l.toxic, l.quality, 'Reasoning: first supported? ' || CASE WHEN d.n_chars % 7 = 0 THEN 'no idea' WHEN d.n_chars % 3 = 0 THEN 'Verdict: UNSUPPORTED' ELSE 'Verdict: supported' END AS reply FROM labels l JOIN documents d USING (doc_id)), vd AS (SELECT *, coalesce(regexp_extract_all(upper(reply), '\\b(SUPPORTED|UNSUPPORTED)\\b', 1)[-1], 'UNPARSED') AS verdict FROM rp)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a judge's reply (a fixed stand-in) and the verdict parsed from it."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    n = F.col("n_chars")
    said = F.when(n % 7 == 0, "no idea").when(n % 3 == 0, "Verdict: UNSUPPORTED").otherwise("Verdict: supported")
    reply = F.concat(F.lit("Reasoning: first supported? "), said)
    return rows.withColumn("verdict", N.verdict(reply, ("SUPPORTED", "UNSUPPORTED")))


@query(f"WITH {REPLY} SELECT doc_id, verdict FROM vd")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "verdict")


@query(f"WITH {REPLY}, s AS (SELECT d.source, avg((verdict = 'SUPPORTED')::INT) AS score FROM vd JOIN documents d USING (doc_id) GROUP BY d.source) SELECT count(*) AS answers, round(avg(score), 6) AS faithfulness FROM s")
def faithfulness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = judged(spark, sf_dir).groupBy("source").agg(F.avg((F.col("verdict") == "SUPPORTED").cast("int")).alias("score"))
    return per.agg(F.count(F.lit(1)).alias("answers"), F.round(F.avg("score"), 6).alias("faithfulness"))


@query(
    f"WITH {REPLY} SELECT count(*) FILTER (quality = 1 AND verdict = 'SUPPORTED') AS agree_supported, count(*) FILTER (quality = 1 AND verdict <> 'SUPPORTED') AS stricter, count(*) FILTER (quality = 0 AND verdict = 'SUPPORTED') AS looser, "
    "count(*) FILTER (quality = 0 AND verdict <> 'SUPPORTED') AS agree_unsupported, round(avg(((quality = 1) = (verdict = 'SUPPORTED'))::INT), 6) AS agreement FROM vd"
)
def judge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts against labels: where they agree, where it is stricter, where looser."""
    good, said = F.col("quality") == 1, F.col("verdict") == "SUPPORTED"
    return judged(spark, sf_dir).agg(
        F.count_if(good & said).alias("agree_supported"), F.count_if(good & ~said).alias("stricter"), F.count_if(~good & said).alias("looser"),
        F.count_if(~good & ~said).alias("agree_unsupported"), F.round(F.avg((good == said).cast("int")), 6).alias("agreement"),
    )


@query(
    "SELECT d.lang, count(*) AS n, round(avg(l.quality), 6) AS grounded, round(count(*) FILTER (l.toxic = 1 AND l.quality = 1)::DOUBLE / nullif(count(*) FILTER (l.toxic = 1), 0), 6) AS verified FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang"
)
def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by group; a rate without anything to measure is null, not zero."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    bad = F.col("toxic") == 1
    verified = F.round(F.try_divide(F.count_if(bad & (F.col("quality") == 1)), F.nullif(F.count_if(bad), F.lit(0))), 6).alias("verified")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("grounded"), verified)
