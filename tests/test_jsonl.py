"""JSON Lines: round trips, order, aborted writes, reports and evaluation sets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import jsonl


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_round_trip_in_the_order_of_files_and_lines(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    rows = [("b", 2, 'say "é"\n🙂', [1, 2]), ("a/x", 9, None, []), ("b", 1, "", None), ("a/x", 3, " ", [7]), ("b", 3, "z" * 70_000, [])]
    df = spark.createDataFrame(rows, "of string, n long, text string, marks array<int>")
    jsonl.save(df, path, F.col("of"), "n")
    assert files(path) == ["a/x.jsonl", "b.jsonl"]
    got = [(r.file, r.line, r.of, r.n, r.text, r.marks) for r in jsonl.scan(spark, path, df.schema.simpleString()).orderBy("file", "line").collect()]
    assert got == [(f"{of}.jsonl", i, of, n, t, m) for (of, n, t, m), i in zip(sorted(rows, key=lambda r: r[:2]), (0, 1, 0, 1, 2), strict=True)]
    jsonl.save(df.where("n = 1"), path, F.col("of"), "n")  # takes the place of one file
    assert jsonl.scan(spark, path).count() == 3


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    jsonl.save(spark.range(3), path, F.lit("old"), "id")
    with pytest.raises(Exception, match="no file name"):
        jsonl.save(spark.range(50), path, F.when(F.col("id") < 49, F.concat(F.lit("f"), F.col("id") % 5)), "id")
    assert files(path) == ["old.jsonl"] and jsonl.scan(spark, path).count() == 3


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    (tmp_path / "_staging-1").mkdir()
    (tmp_path / "_staging-1" / "x.jsonl").write_text("{}\n")
    (tmp_path / "y.jsonl").write_text('{"n": 1}\nno json\n{"n": 3}')
    assert [r.n for r in jsonl.scan(spark, str(tmp_path), "n int").orderBy("line").collect()] == [1, None, 3]
    assert jsonl.scan(spark, f"{tmp_path}/none").count() == 0


def test_reports_are_rounded_and_sorted(spark, tmp_path):
    jsonl.save_report(spark, f"{tmp_path}/r.json", {"z": 1 / 3, "a": {"c": [0.123456, None], "b": 2}})
    text = (tmp_path / "r.json").read_text()
    assert json.loads(text) == {"z": 0.3333, "a": {"c": [0.1235, None], "b": 2}} and text.index('"a"') < text.index('"z"') and text.index('"b"') < text.index('"c"')


def test_rows_of_an_evaluation_set(spark, tmp_path):
    rows = [
        ("ok", "lookup", [("f", 1, 5, "q")], None, None), ("none", "unanswerable", [], "out_of_scope", None), ("null", "unanswerable", None, "off_topic", None), ("span", "lookup", [("f", 5, 5, "q")], None, "a span"),
        ("bare", "derived", [], None, "without evidence"), ("much", "unanswerable", [("f", 1, 2, "q")], "x", "evidence for"), ("why", "unanswerable", None, None, "no reason"), ("open", "lookup", [("f", None, 2, "q")], None, "a span"), ("what", None, [], None, "no type"),
    ]
    df = spark.createDataFrame([(i, "?", "T", t, "g", e, r, "") for i, t, e, r, _ in rows], jsonl.QUESTIONS)
    jsonl.save(df, f"{tmp_path}/set", F.lit("questions"), "id")
    again = jsonl.scan(spark, f"{tmp_path}/set", jsonl.QUESTIONS)
    said = {r.id: r.p for r in again.select("id", jsonl.problem().alias("p")).collect()}
    assert len(said) == len(rows) and all((want is None) == (said[i] is None) and (want or "") in (said[i] or "") for i, *_, want in rows)
