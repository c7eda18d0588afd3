"""Spans of table rows and marked figures, on made-up passages."""

from pyspark.sql import functions as F

from lodestone.plans import highlights as H

TEXT = "Intro\n\nCatch by port\n \n(In tonnes)\n[TABLE]\nheader: Port | 2020\nEast | 5\n[/TABLE]\nEast wind\n[TABLE]\nEast | 6"


def test_rows_of_tables_reach_back_to_the_caption(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "[TABLE]\nEast | 1"), (3, None), (4, "")], "doc_id long, text string")
    texts = {1: TEXT, 2: "[TABLE]\nEast | 1"}
    got = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in H.table_rows(docs, F.col("line").startswith("East")).collect()}
    assert got == {(1, "Catch by port\n \n(In tonnes)\n[TABLE]\nheader: Port | 2020\nEast | 5"), (1, "East wind"), (1, "[/TABLE]\nEast wind\n[TABLE]\nEast | 6"), (2, "[TABLE]\nEast | 1")}


def marked(spark, answer, passage):
    row = spark.createDataFrame([(answer, passage)], "a string, p string").select(H.figures_to_mark(F.col("a"), F.col("p")).alias("d"), F.col("p")).select("d", H.highlight(F.col("p"), F.col("d")).alias("h")).first()
    return row.d, row.h


def test_figures_are_marked_whole_and_once(spark):
    assert marked(spark, "Ports took 1,417 and 417 tons [c1], 417 again.", "1,417 | 417 | 2,417 | 417.5 | 417, 417.") == (["1,417", "417"], "<mark>1,417</mark> | <mark>417</mark> | 2,417 | 417.5 | <mark>417</mark>, <mark>417</mark>.")
    assert marked(spark, "It was 27 tons.", "<b>27</b> & 'x27'") == (["27"], "&lt;b&gt;<mark>27</mark>&lt;/b&gt; &amp; &#x27;x<mark>27</mark>&#x27;")
    assert marked(spark, "It was 8 tons [c1].", "1 of 9") == ([], "1 of 9") and marked(spark, None, None) == ([], "")
