"""What must not grow with a table: folds are written once in a plan, and Python turns slices of a batch into objects."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, items, parsing


def folds_in_filters(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line and "aggregate(" in line]


def test_no_filter_repeats_the_fold_of_blocks(spark):
    docs = spark.createDataFrame([(1, "Head\nbody\nNext\nx"), (2, None)], "doc_id long, text string")
    assert not folds_in_filters(parsing.sections(docs))
    assert parsing.sections(docs).count() == 2


@pytest.mark.parametrize("name", ["filing_headings", "filing_sections"])
def test_no_filter_repeats_the_fold_of_items(spark, data, name):
    assert not folds_in_filters(getattr(items, name)(spark, data))


def test_a_batch_is_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(parsing, "SLICE", 100)
    rows = pa.RecordBatch.from_pydict({"n": list(range(50)), "t": ["x" * 40] * 50})
    got = list(parsing.slices(iter([rows, rows.slice(0, 0)])))
    assert pa.Table.from_batches(got).column("n").to_pylist() == list(range(50)) and max(b.num_rows for b in got) <= 2
    assert [b.num_rows for b in parsing.slices(iter([pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 3})]))] == [1, 1, 1]


def test_pages_and_chunks_of_many_slices(spark):
    long = "\n".join(f"line {i} of some words" for i in range(9000))
    rows = [(i if i % 3 else None, long[: 1000 * i] if i % 7 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name, sizes in (("fixed", (350, 60)), ("recursive", (350, 60))):
        spans = (lambda t: chunking.windows(t, *sizes)) if name == "fixed" else (lambda t: chunking.recursive_spans(t, *sizes))
        want = sorted((d, a, b) for d, t in rows for a, b in spans(t or "") if d is not None)
        assert sorted(tuple(r) for r in chunking.chunk(docs, name).where("doc_id IS NOT NULL").collect()) == want
    pages = parsing.parse_pages(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}))
    assert pages.count() == 60 and pages.where("error = 'no content'").count() == 9


def test_questions_travel_as_plain_rows(spark):
    from lodestone.operators import text_index

    asked = spark.createDataFrame([(1, "a")], "qid long, question string")
    (part,) = text_index._parts(asked, spark.createDataFrame([(1, "a", 2.0)], "qid long, term string, weight double"))
    assert part.value == [(1, "a", 2.0)]


def test_the_reason_of_a_calculation_is_written_once(spark):
    from lodestone.functions import calculations as C

    rows = spark.createDataFrame([([C.parse("CALC: 5 [c1] - 3 [c1] = 2")],)], f"calcs {C.PARSED}")
    known = F.array(F.struct(F.lit("c1").alias("tag"), C.N.amounts(F.lit("a 5 and 3")).alias("amounts"), F.lit(None).cast("double").alias("caption")))
    told = rows.withColumn("known", known).select(C.verdicts(F.col("calcs"), F.col("known")).alias("v"))
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count(C.UNKNOWN) == 1 and [(x.verified, x.reason) for x in told.first().v] == [(True, "")]


def test_a_batch_of_a_stream_brings_what_is_new_without_a_call_a_key(spark):
    from lodestone.streaming import ingest as I

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 3, "same"), ("c", 1, None), (None, 1, "n"), ("d", 1, "late")], "k string, v long, t string")
    known = spark.createDataFrame([("b", 2, "same"), (None, 0, "m"), ("d", 1, "old")], "k string, v long, t string").selectExpr("k", "v", "sha2(t, 256) AS sha")
    got = I.latest_changes(rows, known, "k", "v", "t")
    assert sorted(((r.k, r.v, r.t, r.again) for r in got.collect()), key=str) == sorted([("a", 2, "z", False), ("b", 3, None, True), ("c", 1, "", False), (None, 1, "n", True)], key=str)
    assert "Python" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Pandas" not in plan


def test_a_killed_batch_is_made_again_and_written_once(spark, tmp_path, monkeypatch):
    from lodestone.streaming import ingest as I

    run = lambda: I.ingest(spark, f"{tmp_path}/in", "k long, v long, t string", f"{tmp_path}/out", f"{tmp_path}/cp", "k", "v", "t").awaitTermination()
    put = lambda *rows: spark.createDataFrame(list(rows), "k long, v long, t string").write.mode("append").parquet(f"{tmp_path}/in")
    put((1, 1, "a"), (2, 1, "b"))
    with monkeypatch.context() as m:
        m.setattr(I, "remove", lambda *_: 1 / 0)  # the end of a batch, when all of it is landed
        with pytest.raises(Exception, match="ZeroDivision"):
            run()
    put((1, 2, "a"), (2, 2, "c"))
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 1, "a", False), (2, 1, "b", False), (2, 2, "c", True)]


def test_a_graph_is_made_at_once_and_shards_are_not_put_into_one_task(spark):
    import numpy as np

    from lodestone.operators import graph_index

    rng = np.random.default_rng(7)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 900)] + 0.5 * rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[600:] = x[0]  # many copies: none of them gathers all links
    graph = graph_index.Graph.of(x, [graph_index.level_of(str(i)) for i in range(len(x))])
    assert all(len(own[0]) <= 64 and all(len(y) <= 32 for y in own[1:]) for own in graph.links)
    scores = [(sorted(x @ q)[-10:], sorted(s for s, _ in graph.search(q, 10))) for q in x[:600:10]]
    assert sum(len(got) == 10 and np.allclose(true, got) for true, got in scores) >= 57
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = graph_index.build(vectors, shard=100)
    assert index.rdd.getNumPartitions() >= 9  # adaptive execution puts small partitions together, but none that are asked for
    assert graph_index.search(index, graph_index.every(vectors, graph_index.F.col("vec_id") < 20), 3).count() == 60


def test_a_file_of_a_landed_index_holds_few_blocks(spark, monkeypatch):
    from lodestone.operators import text_index

    monkeypatch.setattr(text_index, "DOCUMENTS", 2)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(80)], "doc_id long, text string").coalesce(1)
    index = text_index.built(docs)
    files = index.groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in files) == 40 and max(r["count"] for r in files) <= text_index.FILE
    found = text_index.search(index, spark.createDataFrame([(1, "word7 common")], "qid long, question string"), 3).orderBy("rank").collect()
    assert found[0].doc_id == 7


def test_texts_are_searched_for_passages_in_slices(spark, monkeypatch):
    from lodestone.plans import evaluation

    def told(batches):
        raise ValueError("sliced")

    monkeypatch.setattr(evaluation, "slices", told)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="sliced"):
        evaluation.occurrences(docs, spark.createDataFrame([(1, "b")], "qid long, passage string")).collect()
