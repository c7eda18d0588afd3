"""What a driver must not hold: no join of the model or of `attach` is left to Spark's sizes of tables, which are those of compressed files."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, pitman_yor


def unhinted(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Join " in line and "strategy=" not in line]


@pytest.fixture
def plans(monkeypatch):
    found = []
    for module in (common, pitman_yor):
        monkeypatch.setattr(module, "staged", lambda df, name, do=common.staged: found.append((name, unhinted(df))) or do(df, name))
    return found


def test_no_join_of_the_model_is_sized_by_spark(spark, plans):
    docs = spark.createDataFrame([(i, f"a b c a b w{i % 7} a b") for i in range(40)], "doc_id long, text string")
    chunks = pitman_yor.encoded(docs, 2)
    numbers = pitman_yor.numbered(chunks.where("bucket >= 0"), 2)
    asked = pitman_yor.requests(chunks.where("bucket < 0"), numbers, 2).where("kind = 2").select("chunk", "bucket", "size", "a", "b", "n")
    _, words, *_ = pitman_yor.model(common.staged(pitman_yor.counted(asked, 2), "sums"))
    assert {"tables", "met", "seated", "root"} <= {name for name, _ in plans}
    assert not [x for x in plans if x[1]] and not unhinted(words) and words.count() > 7


def test_only_hot_groups_of_attach_are_broadcast(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.attach(rows, groups, ["k"], "n")
    assert not unhinted(got) and got.count() == 3000 and got.where("k = 0 AND least = 0 AND n = 2000").count() == 2000


def test_pairs_of_a_chunk_take_few_arrays_of_its_tokens():
    rng = np.random.default_rng(1)
    tokens, numbers = rng.zipf(1.3, 1_000_000) % 5000, np.arange(-1, 4999)
    tracemalloc.start()
    p = pitman_yor.Pairs(tokens, numbers, 7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    assert (p.u[p.pair] == before).all() and (p.w[p.pair] == tokens).all() and len(set(zip(p.u.tolist(), p.w.tolist(), strict=True))) == len(p.u)
    assert most < 32 * len(tokens)
