"""Small-world graphs against exact neighbours."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import graph_index


def clustered(n, seed=4, width=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, width))[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_reaches_true_neighbours_and_few_others():
    x = clustered(1500)
    graph = graph_index.Graph(x)
    for i in range(len(x)):
        graph.insert(i, graph_index.level_of(str(i)))
    assert all(len(own[0]) <= 64 and all(len(y) <= 32 for y in own[1:]) for own in graph.links)
    hits = 0
    for q in x[::15]:
        graph._seen[:], graph._stamp = 0, 0
        true = set(np.argsort(-(x @ q))[:10].tolist())
        hits += len(true & {i for _, i in graph.search(q, 10)})
    assert hits >= 0.95 * 10 * len(x[::15])
    assert np.count_nonzero(graph._seen) < len(x)  # the walk leaves most of the graph alone


def test_index_of_shards_equals_brute_force_nearly(spark):
    x = clustered(600, 9)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, 0.0]), (1002, [0.6, 0.8]), (1003, [1.0, 0.0]), (1004, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = graph_index.build(vectors, shard=100)
    assert index.count() == 604 and index.groupBy("width", "shard").count().agg(F.max("count")).first()[0] < 200
    got = {}
    for r in graph_index.search(index, graph_index.every(vectors, F.col("vec_id") % 20 == 1), 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(1, 600, 20):
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:5]
        found = [v for _, v, _ in sorted(got[q])]
        assert len(found) == 5 and q not in found
        hits += len(set(found) & set(order))
    assert hits >= 0.95 * 150
    assert [v for _, v, _ in sorted(got[1001])] == [1003, 1002, 1004]  # of its width, ties to the smaller id


def test_empty_index(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert graph_index.search(graph_index.build(none), graph_index.every(none, F.lit(True)), 5).count() == 0
