"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import collocations, conversation_repair, decontamination, exact_dedup, html_extract, license_scan, mixing, pitman_yor, sentencepiece_bpe, simhash, suffix_dedup, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.passages(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("offending", "sentences").withColumn("offending", F.size("sentences"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(_table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.occurrences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_sentencepiece, op3_source_mixing, op4_suffix_dedup, op5_lm_scoring, op6_license_scan, op6_license_passages, op7_simhash_near_dedup,
        op8_toxicity, op9_topk_search, op10_html_extract, op11_phrase_mining, op12_conversation_repair, op13_decontamination,
    )
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op3_source_mixing": mixing.SQL, "op6_license_scan": license_scan.sql(), "op9_topk_search": topk_search.SQL, "op11_phrase_mining": collocations.SQL, "op12_conversation_repair": conversation_repair.SQL, "op13_decontamination": decontamination.SQL}
