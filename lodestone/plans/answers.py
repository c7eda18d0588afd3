"""Answers held against the passages they cite: sentences, tags, figures, calculations and the record of what stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import calculations as C
from lodestone.functions import figures as N
from lodestone.functions import text as T
from lodestone.plans.verification import answers
from lodestone.operators.parsing import spread
from lodestone.registry import query, table

# The reply of a model that finds no evidence, and the characters of a passage that a citation quotes.
SENTINEL, EXCERPT = "INSUFFICIENT_EVIDENCE", 200
CLOSED = rf"([.!?])\s+((?:{N.TAG}\s*)+)"
CUT = " "


def sentences(text: Column) -> Column:
    """Sentences of a text; tags that stand behind a full stop belong to the sentence that it ends."""
    tagged = F.regexp_replace(F.translate(text, "【】", "[]"), CLOSED, f"$1 $2{CUT}")
    pieces = F.split(tagged, rf"{CUT}|(?<=[.!?])\s+(?=[A-Z\"'(]|\[(?!c[0-9]))")
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def with_passages(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds `known`, the passages that the answer's `wanted` tags name, and `provided`, whether it was given any.

    Only cited passages travel, and of these what a check reads: a group is as large as an answer's own list of tags.
    """
    cited = rows.select("answer_id", F.explode("wanted").alias("tag"))
    kept = passages.select("answer_id", "tag", N.amounts(F.col("text")).alias("amounts"), N.caption_scale(F.col("text")).alias("caption"),
                           F.substring(T.collapse(F.regexp_replace("text", r"\s+", " ")), 1, EXCERPT).alias("excerpt"))
    found = cited.join(kept, ["answer_id", "tag"]).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("tag", "excerpt", "caption", "amounts"))).alias("known"))
    given = passages.groupBy("answer_id").agg(F.lit(True).alias("provided"))
    rows = rows.join(found, "answer_id", "left").join(given, "answer_id", "left")
    none = F.array().cast(found.schema["known"].dataType)
    return rows.withColumn("known", F.coalesce("known", none)).withColumn("provided", F.coalesce("provided", F.lit(False)))


def verify(given: DataFrame, passages: DataFrame) -> DataFrame:
    """One record for each answer (answer_id, answer), held against passages (answer_id, tag, text).

    A sentence that cites no provided passage is unsupported. An amount that none of its passages states is derived: verified if a
    calculation that holds comes to it, and no claim at all if it is a constant that the calculations use. Null answers, and
    those that were given no passages, count as without evidence.
    """
    text = F.when(F.col("provided"), F.coalesce("answer", F.lit(SENTINEL))).otherwise(F.lit(SENTINEL))
    rows = given.select("answer_id", "answer", C.lines(F.coalesce("answer", F.lit(""))).alias("lines"))
    rows = C.parsed(rows, "lines").drop("lines")
    wanted = F.array_union(N.tags(F.coalesce("answer", F.lit(""))), F.array_distinct(F.flatten(F.flatten(F.col("calcs")["operands"])["tags"])))
    rows = with_passages(rows.withColumn("wanted", wanted), passages)
    rows = rows.withColumn("insufficient", F.startswith(F.upper(F.trim(text)), F.lit(SENTINEL)))
    rows = rows.withColumn("calcs", F.when(F.col("insufficient"), F.array().cast(C.PARSED)).otherwise(F.col("calcs")))
    rows = rows.withColumn("calcs", C.verdicts(F.col("calcs"), F.col("known")))
    rows = rows.withColumn("prose", F.when(F.col("insufficient"), "").otherwise(C.prose(text)))
    labels, calcs = F.col("known")["tag"], F.col("calcs")

    def judged(s: Column) -> Column:
        tags = N.tags(s)
        mine = F.filter(F.col("known"), lambda p: F.array_contains(tags, p["tag"]))

        def working(a: Column) -> Column:
            bare = ~a["percent"] & (a["scale"] == 1.0) & a["value"].isin(*C.CONSTANTS)
            return bare & F.exists(calcs, lambda c: F.array_contains(c["operands"], a["value"]))

        missing = F.filter(N.amounts(N.strip_tags(s)), lambda a: ~F.exists(mine, lambda p: N.stated(a, p["amounts"], p["caption"])) & ~working(a))
        source = lambda a: F.get(F.filter(calcs, lambda c: C.explains(c, a)), 0)
        derived = F.transform(missing, lambda a: F.struct(
            a["raw"].alias("text"), F.coalesce(source(a)["verified"], F.lit(False)).alias("verified"), source(a)["line"].alias("calculation")))
        supported = F.size(mine) > 0
        empty = F.array().cast("array<struct<text:string,verified:boolean,calculation:string>>")
        return F.struct(
            s.alias("sentence"), supported.alias("supported"), F.array_intersect(tags, labels).alias("tags"), F.array_except(tags, labels).alias("unknown"),
            F.when(supported, derived).otherwise(empty).alias("derived"),
        )

    rows = rows.withColumn("judged", F.transform(sentences(F.col("prose")), judged))
    derived, used = F.flatten(F.col("judged")["derived"]), F.flatten(calcs["tags"])
    cited = F.array_distinct(F.concat(F.flatten(F.col("judged")["tags"]), F.array_intersect(used, labels)))
    by_tag = lambda t: F.get(F.filter(F.col("known"), lambda p: p["tag"] == t), 0)["excerpt"]
    rows = rows.select(
        "answer_id", "prose", "insufficient", "judged", calcs.alias("calculations"), derived.alias("derived"),
        F.filter("judged", lambda j: ~j["supported"])["sentence"].alias("unsupported"), F.size(F.filter("judged", lambda j: j["supported"])).alias("cited_sentences"),
        F.array_distinct(F.concat(F.flatten(F.col("judged")["unknown"]), F.array_except(used, labels))).alias("invalid_tags"),
        F.transform(cited, lambda t: F.struct(t.alias("tag"), by_tag(t).alias("excerpt"))).alias("citations"),
        F.array_join(F.concat(F.transform("judged", marked), F.transform(calcs, rendered)), "\n").alias("text"),
    )
    clean = (F.size("unsupported") == 0) & (F.size("invalid_tags") == 0) & ~F.exists("derived", lambda d: ~d["verified"])
    return rows.drop("judged").withColumn("fully_grounded", ~F.col("insufficient") & (F.col("cited_sentences") > 0) & clean)


def marked(j: Column) -> Column:
    """A sentence with what is to be said against it."""
    named = lambda good: F.array_join(F.filter(j["derived"], lambda d: d["verified"] == F.lit(good))["text"], ", ")
    mark = lambda good, word: F.when(named(good) != "", F.concat(F.lit(f"[derived, {word}: "), named(good), F.lit("]")))
    lost = F.when(F.size(j["unknown"]) > 0, F.concat(F.lit("[unsupported: "), F.array_join(j["unknown"], ", "), F.lit(" was not provided]"))).otherwise(F.lit("[unsupported: uncited]"))
    return F.concat_ws(" ", j["sentence"], F.when(~j["supported"], lost), mark(True, "verified"), mark(False, "unverified"))


def rendered(c: Column) -> Column:
    """A calculation with its verdict."""
    return F.concat(c["line"], F.when(c["verified"], F.lit(" [verified]")).otherwise(F.concat(F.lit(" [not verified: "), c["reason"], F.lit("]"))))


def order_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers about the amounts of orders and their passages: by order number right, miscalculated, uncited, or citing nothing provided."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    passages = lines.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("tag"), F.concat(F.lit("Line price $"), F.format_number("l_extendedprice", 2)).alias("text"))
    most = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_extendedprice")))
    rows = lines.groupBy("l_orderkey").agg(most(1).alias("x"), most(2).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("a", F.format_number("x", 2)).withColumn("b", F.format_number("y", 2))
    case = F.col("l_orderkey") % 5
    total = F.format_number((F.col("x") + F.col("y")) * F.when(case == 1, 1.5).otherwise(1.0), 2)
    second = F.when(case == 2, F.lit("")).when(case == 3, F.lit(" [c9]")).otherwise(F.lit(" [c2]"))
    said = F.concat(F.lit("The first line costs $"), "a", F.lit(" [c1]. Both cost $"), total, F.lit(" [c1][c2].\nCALC: "), "a", F.lit(" [c1] + "), "b", second, F.lit(" = "), total)
    return rows.select(F.col("l_orderkey").alias("answer_id"), F.when(case == 4, F.lit(SENTINEL)).otherwise(said).alias("answer")), passages


VERDICTS = (
    "o AS (SELECT l_orderkey AS answer_id, l_orderkey % 5 AS k FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 2), "
    "v AS (SELECT answer_id, k, k = 4 AS insufficient, CASE k WHEN 1 THEN 'mismatch' WHEN 2 THEN 'uncited operand' WHEN 3 THEN 'unknown tag' WHEN 4 THEN NULL ELSE '' END AS reason FROM o)"
)


@query(f"WITH {VERDICTS} SELECT answer_id, insufficient, reason, (k = 0) AS fully_grounded, CASE WHEN k = 3 THEN 'c9' ELSE '' END AS invalid, CASE WHEN k = 4 THEN '' ELSE 'c1,c2' END AS cited FROM v")
def answer_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verifier on answers of which four in five have something wrong."""
    rows = verify(*order_answers(spark, sf_dir))
    return rows.select(
        "answer_id", "insufficient", F.get(F.col("calculations")["reason"], 0).alias("reason"), "fully_grounded",
        F.array_join("invalid_tags", ",").alias("invalid"), F.array_join(F.col("citations")["tag"], ",").alias("cited"),
    )


@query(f"WITH {VERDICTS} SELECT reason, count(*) AS n FROM v WHERE reason <> '' GROUP BY reason")
def calculation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often calculations fail for which reason."""
    rows = verify(*order_answers(spark, sf_dir)).select(F.explode(F.col("calculations")["reason"]).alias("reason"))
    return rows.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def verified_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculation made from each line item, parsed and checked against its passages."""
    rows = spread(table(spark, sf_dir, "lineitem"))
    price, tax = F.format_number("l_extendedprice", 2), F.format_number(F.col("l_extendedprice") * F.col("l_tax"), 2)
    total = F.format_number(F.col("l_extendedprice") * (1 + F.col("l_tax")), 2)
    line = F.concat(F.lit("CALC: "), price, F.lit(" [c1] + "), tax, F.lit(" [c2] = "), total)
    passage = lambda tag, word, x: F.struct(F.lit(tag).alias("tag"), N.amounts(F.concat(F.lit(word), x)).alias("amounts"), F.lit(None).cast("double").alias("caption"))
    # passages are read after the parser, so that only figures as text cross to Python and back
    rows = C.parsed(rows.select("l_orderkey", "l_linenumber", price.alias("price"), tax.alias("tax"), F.array(line).alias("lines")), "lines")
    rows = rows.withColumn("known", F.array(passage("c1", "Price ", F.col("price")), passage("c2", "Tax ", F.col("tax"))))
    rows = rows.select("l_orderkey", "l_linenumber", F.explode(C.verdicts(F.col("calcs"), F.col("known"))).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "v.verified", "v.reason")


@query()
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of answers, tags that stand before one given to the sentence before it, and how many go without a tag."""
    parts = F.filter(sentences(F.col("answer")), lambda s: N.strip_tags(s) != "")
    rows = answers(spark, sf_dir).select("conv_id", "turn", parts.alias("parts")).where(F.size("parts") > 0)
    uncited = F.size(F.filter("parts", lambda s: F.size(N.tags(s)) == 0))
    return rows.select("conv_id", "turn", F.size("parts").cast("long").alias("sentences"), uncited.cast("long").alias("uncited"))
