"""Tables in chunks and sections: never cut, never headings, never overlap."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, parsing
from lodestone.operators.parsing import headed, document_lines, sections

TABLE = "[TABLE]\nheader: Item | 2025\nNet Sales | 5\nTotal Costs\n[/TABLE]"


def test_blocks_keep_tables_whole():
    text = f"One two.\n\n{TABLE}\nThree.\n[TABLE]\nopen | to\n\nthe end"
    got = [(text[a:b], n, t) for a, b, n, t in chunking.blocks(text)]
    assert got == [("One two.", 2, False), (TABLE, 12, True), ("Three.", 1, False), ("[TABLE]\nopen | to\n\nthe end", 6, True)]
    assert chunking.blocks("") == chunking.blocks(" \n\t\n") == []


def test_windows_never_cut_tables_and_never_carry_them():
    text = f"a b c\nd e\n{TABLE}\nf g\nh i j\nk l"
    cut = lambda *sizes: [text[a:b] for a, b in chunking.windows(text, *sizes)]
    assert cut(5, 2) == ["a b c\nd e", f"d e\n{TABLE}", "f g\nh i j", "k l"]
    assert cut(14, 3) == ["a b c\nd e", f"d e\n{TABLE}", "f g\nh i j\nk l"]
    assert cut(100, 10) == [text] and list(chunking.windows("", 5, 2)) == []
    assert list(chunking.windows("x " * 50, 5, 2)) == [(0, 100)]


def test_lines_of_tables_are_no_headings(spark):
    text = f"Intro Part\nSome words follow here.\n{TABLE}\nNext Part\nMore.\n[TABLE]\nLast Row"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [r.line for r in headed(document_lines(docs)).where("head").orderBy("start").collect()] == ["Intro Part", "Next Part"]
    spans = sorted((r.start, r.end, r.title) for r in sections(docs).where("doc_id = 1").collect())
    assert [(text[a:b], t) for a, b, t in spans] == [(text[: text.index("Next") - 1], "Intro Part"), (text[text.index("Next") :], "Next Part")]


def test_chunks_are_judged_by_their_parents_span(spark):
    text = "Head Line\n" + "\n".join(f"line {i} has five words." for i in range(60))
    docs = spark.createDataFrame([(1, text), (None, "One Head\nshort."), (2, None)], "doc_id long, text string")
    got = chunking.effective(chunking.parent_child(docs.where("doc_id = 1"))).collect()
    assert len(got) == 3 and {(r.span_start, r.span_end) for r in got} == {(0, len(text))}
    own = chunking.fixed(docs).selectExpr("*", "CAST(NULL AS LONG) AS parent_start", "CAST(NULL AS LONG) AS parent_end")
    assert all((r.span_start, r.span_end) == (r.start, r.end) for r in chunking.effective(own).collect()) and own.where("doc_id IS NULL").count() == 1


def test_headings_without_the_white_space_around_them(spark):
    said = {"  Net tickets": True, "Total fares. ": False, "\tRoutes ": True, "(In euro)": True, "[TABLE]": False, "a route": False, "One two three four five six seven eight nine": False, " ": False, "A | B": False, "Fares:\r": False}
    rows = spark.createDataFrame([(k,) for k in said], "line string").select("line", T.is_heading(F.col("line")).alias("head")).collect()
    assert {r.line: r.head for r in rows} == said


def test_brackets_close_each_on_its_side(spark):
    said = {"( 81 ) (81 ) ( 81)": "(81) (81) (81)", "$ 4.5 ( $ 3 )": "$4.5 ($3)", "$  x (  )": "$  x ()", "7 %": "7 %"}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", T.tidy_numbers(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == said
    assert parsing.page_text("<table><tr><td>Fuel</td><td>( 81 )</td><td>$ 9</td></tr></table>") == "[TABLE]\nheader: Fuel | (81) | $9\n[/TABLE]"


def test_pages_that_break_are_rows_of_their_own(spark, monkeypatch):
    real = parsing.page_text
    monkeypatch.setattr(parsing, "page_text", lambda html: 1 / 0 if "boom" in html else real(html))
    rows = [("a", b"<p>\xff x"), ("b", None), ("c", b"boom"), ("d", b""), ("d", b"")]
    got = sorted(map(tuple, parsing.parse_pages(spark.createDataFrame(rows, "page_id string, html binary")).collect()))
    assert got == [("a", "� x", None), ("b", None, "no content"), ("c", None, "ZeroDivisionError: division by zero"), ("d", "", None), ("d", "", None)]
    report = parsing.parse_report(spark.createDataFrame(got, "page_id string, text string, error string"), F.lit("all")).first()
    assert (report.pages, report.parsed, report.failed) == (5, 3, 2) and [(f.error, f.n) for f in report.failures] == [("ZeroDivisionError: division by zero", 1), ("no content", 1)]


def test_sections_of_rows_without_an_id_and_of_any_id(spark):
    rows = [(None, "Head\nbody one"), (None, "no head\nNext\nx"), (None, "Head\nbody one"), ("k", None), ("é", ""), ("z", "Last\n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.block, r.title, r.body) for r in chunking.bodies(docs).collect()), key=str)
    want = [(None, 1, "Head", "Head\nbody one"), (None, 1, "Head", "Head\nbody one"), (None, 0, None, "no head"), (None, 1, "Next", "Next\nx"), ("é", 0, None, ""), ("z", 1, "Last", "Last\n")]
    assert got == sorted(want, key=str)
    for strategy in chunking.CHUNKERS:
        found = chunking.chunk(docs, strategy).collect()
        assert {r.doc_id for r in found} == {None, "z"} and all(r.start < r.end for r in found)
