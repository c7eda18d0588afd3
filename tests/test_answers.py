"""Answers about a made-up orchard against their passages: calculations, sentences, marks and records."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import calculations as C
from lodestone.functions import figures as N
from lodestone.plans import answers

CROP = "Harvest (In thousands)\nApples | 640 | 512\nPears | 75.2 | 80"
SPOILT = "Spoilt: 4.5% of apples, 6.25% of pears."
HANDS = "On March 3, 2020 the orchard had 38 pickers and 2,150 trees."


def reasons(spark, passage, lines):
    df = C.parsed(spark.createDataFrame([(passage, [f"CALC: {x}" for x in lines])], "p string, lines array<string>"), "lines")
    known = F.array(F.struct(F.lit("c1").alias("tag"), N.amounts(F.col("p")).alias("amounts"), N.caption_scale(F.col("p")).alias("caption")))
    return [v.reason for v in df.select(C.verdicts(F.col("calcs"), known).alias("v")).first().v]


def test_right_calculations(spark):
    for line in ("640 [c1] - 512 [c1] = 128", "640 [c1] / 512 [c1] * 100 = 125%", "640 【c1】 × 100 = 64,000", "80 [c1] – 75.2 [c1] = 4.8", "(75.2 [c1] − 80 [c1]) / 80 [c1] * 100 = (6)%", "75.2 [c1] + 80 [c1] = ≈ 155", "640 [c1] + 80 [c1] = $0.72 million"):
        assert reasons(spark, CROP, [line]) == [""], line
    assert reasons(spark, SPOILT, ["6.25% [c1] - 4.5% [c1] = 1.75%"]) == reasons(spark, SPOILT, ["6.25 [c1] - 4.5 [c1] = 1.75"]) == [""]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("640 [c1] - 512 [c1] = 130", "mismatch"), ("512 [c1] - 640 [c1] = 128", "mismatch"), ("640 [c1] - 500 [c1] = 140", "operand not in passage"), ("640 [c1] - 512 = 128", "uncited operand"),
        ("640 [c2] - 512 [c1] = 128", "unknown tag"), ("640 [c1] less 512 [c1] = 128", "unparsed"), ("apples outgrew pears", "unparsed"), ("640 [c1] / 1,000 = 3", "mismatch"), ("640 [c1] / 100,000 = 1", "uncited operand"),
    ],
)
def test_wrong_calculations(spark, line, reason):
    assert reasons(spark, CROP, [line]) == [reason]


def test_results_can_be_used_again_if_they_hold(spark):
    assert reasons(spark, CROP, ["640 [c1] - 512 [c1] = 128", "128 [c1] / 512 [c1] * 100 = 25%"]) == ["", ""]
    assert reasons(spark, CROP, ["640 [c1] - 512 [c1] = 131", "131 [c1] / 512 [c1] * 100 = 25.6%"]) == ["mismatch", "operand not in passage"]
    assert reasons(spark, SPOILT, ["$4.5 million [c1] + $6.25 million [c1] = $10.75 million"]) == ["operand not in passage"] and reasons(spark, CROP, []) == []


def test_prose_and_calculations_are_told_apart(spark):
    cases = {
        "Apples grew [c1].\nCALC: 9 [c1] - 3 [c1] = 6\nPears fell [c2].": ("Apples grew [c1].\nPears fell [c2].", ["CALC: 9 [c1] - 3 [c1] = 6"]),
        "Up. CALC: 9 - 3 = 6 CALC: 6 / 3 = 2": ("Up.", ["CALC: 9 - 3 = 6", "CALC: 6 / 3 = 2"]), "Fine.\n* **calc:** 1 + 1 = 2": ("Fine.", ["* **calc:** 1 + 1 = 2"]), "All prose.": ("All prose.", []), "": ("", []),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", C.prose(F.col("a")).alias("p"), C.lines(F.col("a")).alias("l")).collect()
    assert {r.a: (r.p, r.l) for r in rows} == cases


def test_sentences_keep_the_tags_behind_their_stop(spark):
    cases = {
        "Rain came [c1]. Then sun [c2].": ["Rain came [c1].", "Then sun [c2]."], "Rain. [c1] Sun. [c2, c3] Wind": ["Rain. [c1]", "Sun. [c2, c3]", "Wind"], " \n ": [], "At 4.5 degrees it froze.": ["At 4.5 degrees it froze."],
        "Did it freeze? Yes! \"Hard.\"": ["Did it freeze?", "Yes!", "\"Hard.\""],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", answers.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def verify(spark, *texts):
    given = spark.createDataFrame(list(enumerate(texts)), "answer_id long, answer string")
    passages = spark.createDataFrame([(i, t, p) for i in range(len(texts)) for t, p in (("c1", CROP), ("c2", HANDS))], "answer_id long, tag string, text string")
    return [r for _, r in sorted((r.answer_id, r) for r in answers.verify(given, passages).collect())]


def test_cited_sentences(spark):
    good, wide, none, unknown = verify(spark, "The crop was 640 thousand apples [c1].", "There were 38 pickers and 75.2 thousand pears 【c1】[c2].", "The crop was 640 thousand apples.", "It had 2,150 trees [c7].")
    assert good.fully_grounded and wide.fully_grounded and [c.tag for c in wide.citations] == ["c1", "c2"] and good.citations[0].excerpt.startswith("Harvest (In thousands) Apples")
    assert not none.fully_grounded and none.unsupported == ["The crop was 640 thousand apples."] and "[unsupported: uncited]" in none.text
    assert unknown.invalid_tags == ["c7"] and "[unsupported: c7 was not provided]" in unknown.text


def test_derived_figures(spark):
    calc = "\nCALC: 640 [c1] - 512 [c1] = 128"
    bare, shown, wrong, lost, scaled = verify(
        spark, "Apples rose by 128 thousand [c1].", "Apples rose by 128 thousand [c1]." + calc, "Apples rose by 300 thousand [c1]." + calc.replace("128", "300"), "Apples rose by 128 thousand [c1]." + calc.replace("512 [c1]", "512 [c8]"),
        "In percent that is 125% [c1].\nCALC: 640 [c1] / 512 [c1] * 100 = 125%",
    )
    assert [(d.text, d.verified) for d in bare.derived] == [("128 thousand", False)] and bare.text.endswith("[derived, unverified: 128 thousand]") and not bare.fully_grounded
    assert shown.fully_grounded and "[derived, verified: 128 thousand]" in shown.text and shown.text.endswith("= 128 [verified]")
    assert not wrong.fully_grounded and not wrong.derived[0].verified and lost.invalid_tags == ["c8"] and not lost.fully_grounded
    assert scaled.fully_grounded and scaled.derived[0].verified


def test_answers_that_say_nothing(spark):
    refused, null = verify(spark, "insufficient_evidence\n", None)
    assert refused.insufficient and null.insufficient and not refused.citations and not null.fully_grounded
    alone = answers.verify(spark.createDataFrame([(9, "It had 38 pickers [c2].")], "answer_id long, answer string"), spark.createDataFrame([], "answer_id long, tag string, text string")).first()
    assert alone.insufficient and not alone.citations
