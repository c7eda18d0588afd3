"""Facets of questions, filters that they imply and the scope gate, for a corpus of two made-up shipyards."""

import pytest

from lodestone.plans import questions as Q

DOCS = [
    (1, "hull orders grew", "ARK", "FY2021 Q3"), (2, "hull orders fell", "ARK", "FY2021 Q4"), (3, "hull repairs", "ARK", "FY2022 Q1"), (4, "hull orders and masts", "BOW", "FY2021 Q3"), (5, "masts, masts", "BOW", "FY2022 Q1"),
    (6, "sails", "BOW", None), (7, None, None, None), (8, "ballast stones", "BOW", "FY2022 Q1"), (9, "anchors of iron", "ARK", "FY2022 Q2"), (10, "ropes of hemp", "BOW", "FY2022 Q2"), (11, "tar in barrels", "ARK", "FY2022 Q2"),
]
WORDS = [("ark", "ARK"), ("arkwright", "ARK"), ("bow", "BOW")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, ticker string, period_label string")


@pytest.fixture
def facets(spark):
    words = spark.createDataFrame(WORDS, "word string, ticker string")
    return lambda *asked: Q.with_facets(spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), words)


def test_periods_need_fiscal_fy_or_a_quarter(facets):
    said = {
        "orders in the THIRD quarter of fiscal 2026": (2026, 3), "first quarter 2024 at Ark": (2024, 1), "fourth quarter of fiscal year 2020": (2020, 4), "q2 FY2025": (2025, 2), "Q4 of fiscal 2021?": (2021, 4), "q3 2022": (2022, 3),
        "fiscal year 2019": (2019, None), "fiscal 2018 and fiscal 2017": (2018, None), "FY 2023": (2023, None), "fy2023": (2023, None), "sales in 2024": (None, None), "the third quarter": (None, None), "Q3 results": (None, None), "": (None, None),
        "fy2020, but the second quarter of 2021": (2021, 2),
    }
    got = {r.question: (r.fiscal_year, r.fiscal_quarter) for r in facets(*said).collect()}
    assert got == said


def test_companies_and_expansion(facets):
    rows = {r.qid: r for r in facets("Did ARK beat Bow?", "arkwright's q1 2022", "barks and bows in fiscal 2020", None).collect()}
    assert rows[0].tickers == ["ARK", "BOW"] and rows[0].expanded == "Did ARK beat Bow? ARK BOW" and rows[0].period_label is None
    assert rows[1].tickers == ["ARK"] and rows[1].expanded == "arkwright's q1 2022 ARK FY2022 Q1"
    assert rows[2].tickers == [] and rows[2].expanded == "barks and bows in fiscal 2020 FY2020 FY2020"
    assert rows[3].tickers == [] and rows[3].period_label is None


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


def test_filters_companies_in_turn_and_callers(corpus, facets):
    index = Q.context_index(corpus)
    asked = facets("hull orders at Ark", "hull orders at Ark in the third quarter of 2021", "hull orders at Ark or Bow", "masts", "masts at Ark in q1 2023")
    got = found(Q.retrieve(index, asked, 3))
    assert set(got[0]) <= {1, 2, 3, 9, 11} and got[0][:2] != [4] and got[1] == [1]
    assert [{1: "A", 2: "A", 3: "A", 4: "B", 5: "B", 8: "B"}.get(i, "?") for i in got[2]] == ["A", "B", "A"] and set(got[3]) == {4, 5}
    marks = {(r.qid, r.filtered) for r in Q.retrieve(index, asked, 3).collect()}
    assert (1, True) in marks and (4, False) in marks  # nothing of that period: answered without the filter
    assert 4 not in found(Q.retrieve(index, asked, 3, fall_back=False))
    own = found(Q.retrieve(index, asked, 3, {"ticker": "BOW"}))
    assert set(own[2]) <= {4, 5, 6, 8, 10} and own[1] == [4]  # the caller's company with the question's own quarter
    late = found(Q.retrieve(index, asked, 3, {"period_label": "FY2022 Q1"}))
    assert late[0] == [3] and late[1] == [3] and set(late[2]) <= {3, 5, 8}
    assert set(found(Q.retrieve(index, asked, 9, infer=False))[1]) >= {1, 2, 4}
    with pytest.raises(ValueError):
        Q.retrieve(index, asked, 3, {"colour": "x"})


def test_a_document_on_two_lists_counts_once(spark, facets):
    docs = spark.createDataFrame([(1, "hull", "ARK", None), (1, "hull", "BOW", None), (2, "hull hull", "BOW", None), (3, "iron", "ARK", None), (4, "tar", "ARK", None), (5, "rope", "BOW", None), (6, "hemp", "BOW", None)], "doc_id long, text string, ticker string, period_label string")
    got = found(Q.retrieve(Q.context_index(docs), facets("hull at ark and bow"), 9))[0]
    assert got[0] == 1 and got.count(1) == 1 and {2, 3} <= set(got)


def test_scope(spark):
    docs = spark.createDataFrame([("The Arkwright Company", "ARK", 2021), ("Bow Inc", "BOW", 2022)], "company string, ticker string, fiscal_year int")
    outsiders = spark.createDataFrame([("umbra", "UMB"), ("bowline", "BOW")], "word string, ticker string")
    said = {
        "Should I buy arkwright?": "advice", "What is the share price of Umbra": "market data", "the transcript of the earnings call": "other documents", "weather in port": "not filings",
        "How many ships has Umbra?": "outsider", "Has Umbra more ships than Bow?": None, "ships of Bowline": None, "umbrage taken": None, "Arkwright's ships in 2020": "too early", "Arkwright's ships in 2020 and 2021": None, "ships in 2001": None, "": None,
    }
    asked = spark.createDataFrame([(q, q) for q in said] + [(None, None)], "qid string, question string")
    got = {r.qid: r.why for r in Q.scope_check(asked, docs, outsiders).collect()}
    assert got == said | {None: None}
