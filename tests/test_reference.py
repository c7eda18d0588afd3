"""Registered queries against their SQL in DuckDB, and functions against known values."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import calculations as C
from lodestone.functions import figures as N
from lodestone.functions import text as T
from lodestone.operators import chunking, dense
from lodestone.operators.parsing import page_text
from lodestone.plans import evaluation

@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    mine = catalog.queries()[name](spark, data).toPandas()
    theirs = con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))
    assert rows(mine) == rows(theirs)


def test_dense_search_of_many_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3) if i % 7 else None, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(1, 120)] + [(200, 1, None), (220, 1, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    clean = [(i, l, np.array(v)) for i, l, v in rows if v is not None]
    for same in (False, True):
        got = {(r.qid, r.rank): (r.vec_id, r.score) for r in dense.nearest(table, 4, cosine=False, same_label=same).collect()}
        want = {}
        for q, label, v in clean:
            if q % 20 == 0:
                near = [(-float(v @ w), i) for i, l, w in clean if i != q and len(w) == len(v) and (not same or (label is not None and l == label))]
                want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(near)[:4])}
        assert got == want


def test_tokens_keep_figures_and_trailing_stops(spark):
    row = spark.range(1).select(T.tokens(F.lit("Q3 FY2026. sales of $(109,417)")).alias("t")).first()
    assert row.t == ["q3", "fy2026.", "sales", "of", "109,417"]


def test_fixed_chunks_carry_whole_lines(spark):
    text = "\n".join(f"a{i} b c d e" for i in range(6))
    rows = chunking.fixed(spark.createDataFrame([(1, text)], "doc_id long, text string"), target=10, overlap=5).orderBy("start").collect()
    parts = [text[r.start : r.end].split("\n") for r in rows]
    assert parts[0] == ["a0 b c d e", "a1 b c d e"] and parts[1][0] == "a1 b c d e"
    assert all(len(" ".join(p).split()) <= 10 for p in parts)


def test_bad_sizes_and_strategies_are_refused(spark):
    with pytest.raises(ValueError):
        chunking.check_sizes(10, 10)
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([], "doc_id long, text string"), "other")


def test_recursive_spans():
    text = "one two. three four five.\nsix seven eight nine ten"
    edges, words = chunking.piece_edges(text, 3)
    pieces = [text[a:b] for a, b in zip(edges, edges[1:])]
    assert "".join(pieces) == text and words[-1] == 10 and all(len(p.split()) <= 3 for p in pieces)
    assert pieces == ["one two. ", "three four five.\n", "six ", "seven ", "eight ", "nine ", "ten"]
    spans = [text[a:b].split() for a, b in chunking.recursive_spans(text, 5, 2)]
    assert spans == [["one", "two.", "three", "four", "five."], ["six", "seven", "eight", "nine", "ten"]]
    letters = " ".join("abcdefgh")
    spans = [letters[a:b].split() for a, b in chunking.recursive_spans(letters, 3, 1)]
    assert spans == [list("abc"), list("cde"), list("efg"), list("gh")]
    assert chunking.recursive_spans("", 3, 1) == [] and chunking.recursive_spans(" \n ", 3, 1) == []


def test_gold_spans_begin_and_end_inside_words(spark):
    docs = spark.createDataFrame([(1, "see xalpha beta gamma delta epsilon and more"), (2, "alpha beta gamma delta epsilonic"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "gamma del"), (3, "alpha beta gamma delta")], "item_id long, text string")
    got = sorted((r.qid, r.doc_id, r.start) for r in evaluation.gold_spans(docs, bench).collect())
    assert got == [(1, 1, 5), (1, 2, 0), (2, 1, 16), (2, 2, 11), (3, 1, 5), (3, 2, 0)]


def test_page_text_renders_tables():
    html = "<p>Sales</p><table><tr><td>Net</td><td>$</td><td>109,417</td></tr><tr><td>Loss</td><td>(54,647</td><td>)</td></tr></table><script>x</script>"
    assert page_text(html) == "Sales\n[TABLE]\nheader: Net | $109,417\nLoss | (54,647)\n[/TABLE]"


@pytest.mark.parametrize(
    ("line", "held", "reason"),
    [
        ("CALC: 10 [c1] + 5 [c2] = 15", True, ""),
        ("- **CALC: 10 [c1] / 5 [c2] * 100 = 200%", True, ""),
        ("CALC: 10 [c1] + 5 [c2] = 16", False, "mismatch"),
        ("CALC: 10 + 5 [c2] = 15", False, "uncited operand"),
        ("CALC: 10 [c9] + 5 [c2] = 15", False, "unknown tag"),
        ("CALC: 11 [c1] + 5 [c2] = 16", False, "operand not in passage"),
        ("sales rose", False, "unparsed"),
    ],
)
def test_calculations(spark, line, held, reason):
    known = F.array(*[F.struct(F.lit(tag).alias("tag"), N.amounts(F.lit(text)).alias("amounts"), N.caption_scale(F.lit(text)).alias("caption")) for tag, text in (("c1", "it was 10 then"), ("c2", "and 5"))])
    row = C.parsed(spark.createDataFrame([([line],)], "lines array<string>"), "lines").select(C.verdicts(F.col("calcs"), known).alias("v")).first()
    assert (row.v[0].verified, row.v[0].reason) == (held, reason)


def test_every_line_item_is_verified(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    got = catalog.queries()["verified_calculations"](spark, data).select("l_orderkey", "l_linenumber")
    assert got.exceptAll(items).count() == items.exceptAll(got).count() == 0


def test_evaluate_takes_arithmetic_only():
    assert N.evaluate("2 * (3 - 1)") == 4 and N.evaluate("1 / 0") is None and N.evaluate("__import__('os')") is None


def test_passages_are_found_wherever_they_stand(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "PASSAGES", 12)
    docs = spark.createDataFrame([(1, "abab abab é世é世é", 0), (2, None, 0), (3, "", 0), (None, "xx é世é", 0), (4, "b", 0)], "doc_id long, text string, qid int")
    asked = [(10, "abab"), (11, "é世é"), (12, "b"), (13, ""), (14, None), (15, "abab"), (None, "xx")]
    got = {(r.qid, r.doc_id, r.start, r.end) for r in evaluation.occurrences(docs, spark.createDataFrame(asked, "qid long, passage string")).collect()}
    texts = {1: "abab abab é世é世é", None: "xx é世é", 4: "b"}
    assert got == {(q, d, i, i + len(p)) for q, p in asked if p for d, t in texts.items() for i in range(len(t)) if t.startswith(p, i)}
