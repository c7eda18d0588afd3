"""Strategies on a made-up shelf of recipes."""

import pytest

from lodestone.plans import retrieval as R

DOCS = [(1, "rye bread with seeds"), (2, "wheat bread"), (3, "plum cake"), (4, "cherry cake with rye"), (5, "barley soup"), (6, None), (7, "leek soup"), (8, "oat bread")]


@pytest.fixture
def shelf(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 8]) for i, _ in DOCS if i != 7] + [(7, None)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "plum cake", [1.0, 1 / 8]), (2, "  ", [0.0, 1.0]), (3, "leek soup", None), (4, "zebra", [1.0, 1.0])], "qid long, question string, embedding array<double>")
    return docs, vectors, asked


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


def test_strategies(shelf):
    dense, bm25, both = (found(R.retrieve(s, *shelf, 3)) for s in R.STRATEGIES)
    assert dense == {1: [1, 2, 3], 4: [8, 6, 5]}  # blank questions and those without a vector have no dense list
    assert bm25[1][:1] == [3] and bm25[3][:1] == [7] and set(bm25) == {1, 3}
    assert both[1][0] == 3 and 1 in both[1] and both[3][0] == 7 and both[4] == [8, 6, 5] and 2 not in both
    with pytest.raises(ValueError, match="unknown strategy"):
        R.retrieve("sparse", *shelf, 3)
