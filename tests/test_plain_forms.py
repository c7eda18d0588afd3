"""Plain calculations are read by Arrow and bare amounts without searches for units; what either gives is what the parser and the searches give."""

import itertools

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone import catalog
from lodestone.functions import calculations as C
from lodestone.functions import figures as N

NUMBERS = ["0", "12", "00012", "1,234.50", "1,23", "1234,567", "1.", "$5", "€7", "10%", "5 million", "12345678901234567890", "٣"]


def test_plain_lines_are_read_as_the_parser_reads_them(spark):
    kind = to_arrow_type(StructType.fromDDL(f"c {C.PARSED}")["c"].dataType).value_type
    lines = [f"CALC: {a}{t} {s} {b} [c2] = {r}" for a, b, r in itertools.product(NUMBERS, NUMBERS, ["0", "$1,234.50", "-3", "3.14159", "7%", "8 million"]) for t, s in (("", "+"), (" [c1]", "-"), (" [c1]", "/"), ("  [c10]", "*"), (" [c1, c3]", "x"))]
    lines += ["CALC: 1 + 2 = 3\n", "CALC: 1 + 2 = 3 ", "x CALC: 1 + 2 = 3", "calc: 1 + 2 = 3", "CALC: 1 ** 2 = 1", "CALC: (1 + 2) * 3 = 9", "CALC: 1 + 2 + 3 = 6", "CALC: 0.1 + 0.2 = 0.3", "", "sales rose"]
    want, got = [C.parse(x) for x in lines], C.parse_all(pa.array(lines), kind).to_pylist()
    assert [repr(x) for x in got] == [repr(x) for x in pa.array(want, kind).to_pylist()]
    assert 250 < pa.compute.extract_regex(pa.array(lines), C.PLAIN).is_valid().to_pylist().count(True) < len(lines)


def test_lists_of_lines_keep_their_places(spark):
    rows = [(1, ["CALC: 1 + 2 = 3", "CALC: (1 + 2) * 3 = 9"]), (2, None), (3, []), (4, ["none", "CALC: 4 / 0 = 1"])]
    got = {r.k: [(c.line, len(c.operands), c.computed) for c in r.calcs] for r in C.parsed(spark.createDataFrame(rows, "k long, lines array<string>").coalesce(1), "lines").collect()}
    assert got == {1: [("CALC: 1 + 2 = 3", 2, 3.0), ("CALC: (1 + 2) * 3 = 9", 3, 9.0)], 2: [], 3: [], 4: [("none", 0, None), ("CALC: 4 / 0 = 1", 2, None)]}


def test_line_items_never_reach_the_parser(spark, data, monkeypatch):
    monkeypatch.setattr(C, "parse", lambda line: 1 / 0)
    rows = catalog.queries()["verified_calculations"](spark, data)
    assert rows.groupBy("verified", "reason").count().collect() == [(True, "", spark.read.parquet(f"{data}/lineitem.parquet").count())]


def test_bare_amounts_are_those_that_the_searches_find(spark):
    texts = ["sold 1,234.50 for $5 and €7.5 million", "10% of 3 billions", "in 1999 it was 2024, then 1234", "May 5, 2020 and 6th, 2021", "7 percent", "$ 12", "5.", "1,23", "12 thousand 0.5"]
    got = [[tuple(a) for a in r.a] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.amounts(F.col("t")).alias("a")).orderBy("i").collect()]
    plain = lambda raw, x: (raw, x, False, 1.0, False)
    assert got == [
        [plain("1,234.50", 1234.5), ("$5", 5.0, False, 1.0, True), ("€7.5 million", 7.5, False, 1e6, True)], [("10%", 10.0, True, 1.0, False), ("3 billions", 3.0, False, 1e9, False)], [plain("1234", 1234.0)], [],
        [("7 percent", 7.0, True, 1.0, False)], [("$ 12", 12.0, False, 1.0, True)], [plain("5", 5.0)], [plain("1", 1.0), plain("23", 23.0)], [("12 thousand", 12.0, False, 1e3, False), plain("0.5", 0.5)],
    ]
