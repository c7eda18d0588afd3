"""Items, parts, references, tables and signatures of filings."""

import pytest

from lodestone.operators import items

FILING = """Cover of the report
[TABLE]
header: Item 1. | Accounts | 3
PART II
[/TABLE]
  PART I — FINANCE
Item 1. Accounts
They follow.
See Item 1A of the report of last year.
Item 2 Comments of the board 
ITEM 3
Signatures
Item 4. a {long}
Part II
Part I, Item 1A of the last report says more.
part i. item 1a: Risks
Part iv: Item 15 – Annexes
Annex 9 """.replace("{long}", "word " * 24)


@pytest.fixture
def parsed(spark):
    rows = [(1, FILING), (2, None), (3, ""), (3, "no heading"), (None, "Item 7a. Rates\r\nx \n"), (5, "Signatures\nItem 5. Shares\nSIGNATURE\nb\nItem 6 Last\nc"), (6, "x\n" * 20_000 + "Item 8. Long\n" + "y" * 100_000)]
    return items.with_sections(spark.createDataFrame([(*r, "f", 0) for r in rows], "doc_id long, text string, found string, part int")).collect()


def sections(parsed, doc_id, at=0):
    row = [r for r in parsed if r.doc_id == doc_id][at]
    return [(s.part, s.item, s.title, row.text[s.start : s.end]) for s in row.sections]


def test_parts_references_and_tables(parsed):
    got = sections(parsed, 1)
    assert [(p, i, t) for p, i, t, _ in got] == [(1, "1", "Accounts"), (1, "2", "Comments of the board"), (1, "1A", "Risks"), (4, "15", "Annexes")]
    assert got[0][3] == "Item 1. Accounts\nThey follow.\nSee Item 1A of the report of last year."
    assert got[2][3] == "part i. item 1a: Risks"


def test_the_last_section_stops_at_signatures(parsed):
    assert sections(parsed, 1)[-1][3] == ""  # they stand before it
    assert sections(parsed, 5) == [(0, "5", "Shares", "Item 5. Shares\nSIGNATURE\nb"), (0, "6", "Last", "")]
    assert sections(parsed, None) == [(0, "7A", "Rates", "Item 7a. Rates\r\nx")]


def test_nothing_and_long_texts(parsed):
    assert sections(parsed, 2) == sections(parsed, 3) == sections(parsed, 3, 1) == []
    assert sections(parsed, 6)[0][:3] == (0, "8", "Long") and len(sections(parsed, 6)[0][3]) == 100_013


def test_coverage_by_form(spark):
    text = "Part I\nItem 1. A\nItem 2. B\nPart II\nItem 1A. C\nItem 9. D"
    rows = items.with_coverage(items.with_sections(spark.createDataFrame([("10-q", text), ("10-K", text), ("8-K", text), (None, None)], "form string, text string")))
    quarter, year, other, none = rows.collect()
    assert quarter.ok and quarter.unexpected == ["2 9"] and quarter.missing == ["1 3", "1 4", "2 1", "2 2", "2 3", "2 4", "2 5", "2 6"]
    assert not year.ok and year.missing_critical == ["1 1A", "2 7", "2 7A", "2 8"] and year.unexpected == ["2 1A"]
    assert other.ok and none.ok and not other.missing and not other.unexpected and len(other.found) == 4 and not none.found


def test_keys(spark):
    row = spark.range(1).select(*[items.key(items.F.lit(p), items.F.lit("7A")).alias(f"k{p}") for p in range(5)]).first()
    assert list(row) == ["Item 7A", "Part I.Item 7A", "Part II.Item 7A", "Part III.Item 7A", "Part IV.Item 7A"]
