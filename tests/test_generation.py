"""Evaluation of answers about a made-up bakery: context, records, rates and the answer gate."""

import pytest

from lodestone.plans import generation as G

PASSAGE = "Loaves (In thousands)\nRye | 30 | 24\nWheat | 41.5 | 40"
ANSWERS = [
    (1, "lookup", "30 thousand", "Rye came to 30 thousand [c1]."), (2, "lookup", "30 thousand", "Rye came to 31 thousand [c1]."), (3, "derived", "6 thousand", "Rye grew by 6 thousand [c1].\nCALC: 30 [c1] - 24 [c1] = 6"),
    (4, "derived", "$0.006 million", "Rye grew by 6 thousand [c1].\nCALC: 30 [c1] - 24 [c1] = 7"), (5, "lookup", "Rye bread.", "It was rye bread."), (6, "cross", "41,500", "INSUFFICIENT_EVIDENCE"), (7, None, None, "Wheat [c9]."),
]


@pytest.fixture
def tables(spark):
    given = spark.createDataFrame([(i, a) for i, _, _, a in ANSWERS], "answer_id long, answer string")
    passages = spark.createDataFrame([(i, "c1", PASSAGE) for i, *_ in ANSWERS], "answer_id long, tag string, text string")
    return given, passages, spark.createDataFrame([(i, t, g) for i, t, g, _ in ANSWERS], "answer_id long, type string, gold_answer string")


def test_records(tables):
    got = {r.answer_id: r for r in G.results(*tables).collect()}
    assert [got[i].gold_figures_present for i in (1, 2, 3, 4, 5)] == [True, False, True, True, True] and not got[6].gold_figures_present
    assert (got[1].derived, got[2].derived, got[2].derived_verified) == (0, 1, 0) and (got[3].derived, got[3].derived_verified, got[3].calculations_verified) == (1, 1, 1)
    assert got[4].reasons == ["mismatch"] and got[4].calculations == 1 and got[4].calculations_verified == 0 and not got[4].fully_grounded
    assert got[5].unsupported == 1 and got[6].insufficient and got[7].invalid_tags == 1 and len(got) == 7


def test_rates_are_absent_where_nothing_was_measured(spark, tables):
    by = {r.type: r for r in G.rates(G.results(*tables)).collect()}
    assert set(by) == {None, "lookup", "derived", "cross", "none"} and by[None].questions == 7
    assert by["cross"].insufficient_evidence == 1.0 and by["cross"].fully_grounded == 0.0 and by["cross"].derived_verified is None and by["cross"].figures_accounted is None
    assert by["derived"].derived_verified == by["derived"].calculations_verified == 0.5 and by["none"].calculations_verified is None and by["lookup"].derived_verified == 0.0
    assert all(r.faithfulness is None and r.correct is None for r in by.values())
    judged = spark.createDataFrame([(1, 1.0, "correct"), (2, 0.5, "partial"), (3, 0.0, None), (6, 1.0, "correct")], "answer_id long, faithfulness double, correctness string")
    by = {r.type: r for r in G.rates(G.results(*tables, judged)).collect()}
    assert (by["lookup"].faithfulness, by["lookup"].correct, by["lookup"].correct_or_partial) == (0.75, 0.5, 1.0)
    assert (by["derived"].faithfulness, by["derived"].correct) == (0.0, None) and by["cross"].faithfulness is None and by[None].faithfulness == 0.5


def test_gate_and_failures(tables):
    rows = G.results(*tables)
    assert {r.answer_id: r.reason for r in G.answer_check(rows).collect()} == {1: None, 2: None, 3: None, 4: None, 5: "verification_failed", 6: "insufficient_evidence", 7: "verification_failed"}
    assert [(r.reason, r.n) for r in G.failures(rows).collect()] == [("mismatch", 1)]
    assert G.rates(G.results(*[t.where("false") for t in tables])).where("questions > 0").count() == 0


def test_gold_context_in_corpus_order(spark):
    chunks = spark.createDataFrame([("b", 2, 0, 100), ("a", 1, 50, 90), ("c", 1, 0, 60), ("d", 1, 90, 200), ("e", 3, 0, 9)], "chunk_id string, doc_id long, start long, end long")
    spans = spark.createDataFrame([(7, 1, 40, 80), (7, 1, 55, 60), (7, 2, 10, 20), (8, 1, 80, 100), (9, 3, 20, 30)], "qid long, doc_id long, start long, end long")
    got = sorted((r.qid, r["rank"], r.chunk_id) for r in G.gold_context(chunks, spans, 2).collect())
    assert got == [(7, 1, "c"), (7, 2, "a"), (8, 1, "a"), (8, 2, "d")]
