"""What a question says about the corpus: companies and fiscal periods as facets, in filters, expansion, lists per company and the scope gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import text_index
from lodestone.operators.lexical import TF
from lodestone.plans.evaluation import occurrences
from lodestone.registry import query, table

# How a question names a quarter with its year, or a fiscal year; of these the first that fits counts.
QUARTERS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
QUARTER = r"(?i)\b(first|second|third|fourth)\s+quarter\s+(?:of\s+)?(?:fiscal\s+)?(?:year\s+)?(\d{4})\b"
SHORT_QUARTER = r"(?i)\bq([1-4])\s*(?:of\s+)?(?:fy|fiscal\s*(?:year\s*)?)?\s*(\d{4})\b"
FISCAL_YEAR, FY = r"(?i)\bfiscal\s+(?:year\s+)?(\d{4})\b", r"(?i)\bfy\s?(\d{4})\b"
ANY_YEAR = r"(?i)\b(?:fiscal\s+(?:year\s+)?)?((?:19|20)\d{2})\b"
# What filings don't answer, whatever the company; words of a company's name that tell nothing.
TOPICS = {
    "advice": r"\b(should i|would you recommend|is it a good|good investment|worth buying|buy or sell)\b",
    "market data": r"\b(share price|stock price|market cap|market capitali[sz]ation|trading at)\b",
    "other documents": r"\b(earnings call|analyst call|press release|investor day|transcript)\b",
    "not filings": r"\b(weather|temperature|forecast for today)\b",
}
IGNORED = ("inc", "corp", "corporation", "company", "the")
_SEP = "\x1f"


def period(question: Column) -> tuple[Column, Column]:
    """Fiscal year and quarter that a question names; a bare year names nothing."""
    got = lambda pattern, n: F.nullif(F.regexp_extract(question, pattern, n), F.lit(""))
    word = F.lower(got(QUARTER, 1))
    quarter = F.coalesce(*[F.when(word == w, n) for w, n in QUARTERS.items()], got(SHORT_QUARTER, 1).cast("int"))
    year = F.when(word.isNotNull(), got(QUARTER, 2)).otherwise(F.coalesce(got(SHORT_QUARTER, 2), got(FISCAL_YEAR, 1), got(FY, 1)))
    return year.cast("int"), quarter


def with_facets(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """asked (qid, question) with tickers (sorted), fiscal_year, fiscal_quarter, period_label and `expanded`: the question with the corpus's spelling of these.

    dictionary has word (one word, lower case) and ticker; a question names a ticker if one of its words does. Null questions name nothing.
    """
    words = asked.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    named = words.join(dictionary.select("word", "ticker"), "word").groupBy("qid").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    year, quarter = period(F.col("question"))
    rows = asked.join(named, "qid", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
    rows = rows.withColumn("fiscal_year", year).withColumn("fiscal_quarter", quarter)
    fy = F.concat(F.lit("FY"), "fiscal_year")
    rows = rows.withColumn("period_label", F.concat(fy, F.coalesce(F.concat(F.lit(" Q"), "fiscal_quarter"), F.lit(""))))
    label = F.when(F.col("fiscal_quarter").isNull(), F.concat("period_label", F.lit(" "), "period_label")).otherwise(F.col("period_label"))
    return rows.withColumn("expanded", F.concat_ws(" ", "question", F.nullif(F.array_join("tickers", " "), F.lit("")), label))


def context_index(docs: DataFrame) -> DataFrame:
    """A text index of docs (doc_id, text, ticker, period_label) over each text with what it is of before it; searched per ticker and period."""
    said = F.concat_ws(" ", "ticker", "period_label")
    rows = docs.withColumn("text", F.concat(said, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return text_index.built(rows, F.concat(F.coalesce("ticker", F.lit("")), F.lit(_SEP), F.coalesce("period_label", F.lit(""))), "context-index")


def retrieve(index: DataFrame, asked: DataFrame, k: int, caller: dict[str, str] | None = None, fall_back: bool = True, infer: bool = True) -> DataFrame:
    """qid, doc_id, ticker, score, rank, filtered: the k best for questions with facets, under the filter that each implies.

    A single ticker and a period with a quarter are conditions; keys of the caller (ticker, period_label) win over them. Several tickers, of
    which the caller names none, give a list each, taken in turn, under the caller's conditions alone. If nothing is left, a question is
    answered under the caller's conditions only. All this is chosen from one search; a document on two lists counts once.
    """
    caller = caller or {}
    if unknown := caller.keys() - {"ticker", "period_label"}:
        raise ValueError(f"no such attribute: {', '.join(sorted(unknown))}")
    found = text_index.search(index, asked.select("qid", F.col("expanded").alias("question")), k).drop("rank")
    parts = F.split("label", _SEP)
    rows = found.withColumn("ticker", parts[0]).withColumn("period", parts[1]).drop("label").join(asked.select("qid", "tickers", "fiscal_quarter", "period_label"), "qid")
    for name, value in caller.items():
        rows = rows.where(F.col("ticker" if name == "ticker" else "period") == value)
    several = F.lit(infer and "ticker" not in caller) & (F.size("tickers") > 1)
    company = F.lit(not infer or "ticker" in caller) | (F.size("tickers") != 1) | (F.col("ticker") == F.get("tickers", 0))
    quarter = F.lit(not infer or "period_label" in caller) | F.col("fiscal_quarter").isNull() | (F.col("period") == F.col("period_label"))
    rows = rows.withColumn("good", F.when(several, F.array_contains("tickers", F.col("ticker"))).otherwise(company & quarter)).withColumn("several", several)
    rows = rows.withColumn("filtered", F.max("good").over(Window.partitionBy("qid"))).where(F.col("good") | (F.lit(fall_back) & ~F.col("filtered")))
    turn = F.col("several") & F.col("filtered")
    own = Window.partitionBy("qid", F.when(turn, F.col("ticker"))).orderBy(F.desc("score"), "doc_id")
    rows = rows.withColumn("position", F.row_number().over(own)).withColumn("of", F.when(turn, F.col("ticker")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("position", "of"))).where("again = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("position", "of", "doc_id"))).where(F.col("rank") <= k)
    return rows.select("qid", "doc_id", "ticker", "score", "rank", "filtered")


def company_words(companies: DataFrame) -> DataFrame:
    """The telling words of names (company): lower-case words of three letters or more."""
    words = companies.select(F.explode(F.regexp_extract_all(F.lower("company"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(*IGNORED)).distinct()


def scope_check(asked: DataFrame, docs: DataFrame, outsiders: DataFrame) -> DataFrame:
    """qid, why: what puts a question outside of the corpus before any retrieval, null if nothing does.

    A topic of TOPICS; else a known outsider (outsiders: word, ticker), unless a company of the corpus (docs: company, ticker, fiscal_year) is
    named too or the corpus has the outsider's ticker; else, with such a company, years that all lie before the corpus.
    """
    lowered = asked.select("qid", F.lower(F.coalesce("question", F.lit(""))).alias("said"))
    words = company_words(docs.select("company").distinct())
    inside = occurrences(lowered.select(F.col("qid").alias("doc_id"), F.col("said").alias("text")), words.select(F.col("word").alias("qid"), F.col("word").alias("passage")))
    inside = inside.select(F.col("doc_id").alias("qid")).distinct().withColumn("inside", F.lit(True))
    absent = outsiders.join(docs.select("ticker").distinct(), "ticker", "left_anti")
    tokens = lowered.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    outside = tokens.join(absent.select("word"), "word").select("qid").distinct().withColumn("outside", F.lit(True))
    first = docs.agg(F.min("fiscal_year").alias("first"))
    rows = lowered.join(inside, "qid", "left").join(outside, "qid", "left").join(F.broadcast(first))
    years = F.transform(F.regexp_extract_all("said", F.lit(ANY_YEAR), F.lit(1)), lambda y: y.cast("int"))
    here = F.coalesce("inside", F.lit(False))
    topic = F.coalesce(*[F.when(F.col("said").rlike(p), F.lit(t)) for t, p in TOPICS.items()])
    other = F.when(F.col("outside") & ~here, F.lit("outsider")).when(here & (F.array_max(years) < F.col("first")), F.lit("too early"))
    return rows.select("qid", F.coalesce(topic, other).alias("why"))


#: Words of companies that the corpus does not hold, for the queries below.
OUTSIDERS = {"umbra": "UMB", "penumbra": "PEN"}
FIRST_YEAR = 2020


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, quarter = F.col("doc_id") % 5 + FIRST_YEAR, F.col("doc_id") % 4 + 1
    label = F.concat(F.lit("FY"), year, F.lit(" Q"), quarter)
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("ticker"), F.col("source").alias("company"), year.alias("fiscal_year"), label.alias("period_label"))


_SUFFIX = """CASE item_id % 4 WHEN 0 THEN '' WHEN 2 THEN concat(' at SRC', item_id % 20, ' and src', (item_id + 7) % 20) ELSE concat(' at src', item_id % 20) END,
CASE item_id % 6 WHEN 0 THEN ' in the third quarter of fiscal 2021' WHEN 1 THEN ' in Q2 FY2022' WHEN 2 THEN ' in fiscal year 2023' WHEN 3 THEN ' in fy 2024' WHEN 4 THEN ' in 2022' ELSE '' END,
CASE WHEN item_id % 9 = 4 THEN ' or at Umbra' WHEN item_id % 7 = 3 THEN ', should I buy' WHEN item_id % 5 = 2 THEN ' as in 2001' ELSE '' END"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that go on to name companies and periods."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.expr(f"concat(text, {_SUFFIX})").alias("question"))


def _dictionary(docs: DataFrame) -> DataFrame:
    return docs.select(F.lower("ticker").alias("word"), "ticker").where("ticker IS NOT NULL").distinct()


ASKED = rf"""aq AS (SELECT item_id AS qid, concat(text, {_SUFFIX}) AS question FROM benchmark),
tk AS (SELECT qid, list_sort(list(DISTINCT source)) AS tickers FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '\w+')) AS word FROM aq) w JOIN (SELECT DISTINCT source FROM documents) s ON lower(source) = word GROUP BY qid),
fa AS (SELECT qid, question, coalesce(tickers, []) AS tickers, regexp_extract(question, '{QUARTER}', 1) AS qw, regexp_extract(question, '{QUARTER}', 2) AS qy, regexp_extract(question, '{SHORT_QUARTER}', 1) AS sq, regexp_extract(question, '{SHORT_QUARTER}', 2) AS sy, regexp_extract(question, '{FISCAL_YEAR}', 1) AS fy, regexp_extract(question, '{FY}', 1) AS f2 FROM aq LEFT JOIN tk USING (qid)),
fc AS (SELECT qid, question, tickers, coalesce(nullif(qy, ''), nullif(sy, ''), nullif(fy, ''), nullif(f2, ''))::INT AS fiscal_year, coalesce(CASE lower(qw) WHEN 'first' THEN 1 WHEN 'second' THEN 2 WHEN 'third' THEN 3 WHEN 'fourth' THEN 4 END, nullif(sq, '')::INT) AS fiscal_quarter FROM fa),
fl AS (SELECT *, 'FY' || fiscal_year || coalesce(' Q' || fiscal_quarter, '') AS period_label FROM fc),
fx AS (SELECT *, concat_ws(' ', question, nullif(array_to_string(tickers, ' '), ''), CASE WHEN fiscal_quarter IS NULL THEN period_label || ' ' || period_label ELSE period_label END) AS expanded FROM fl),
cx AS (SELECT doc_id, source, lang, 'FY' || (doc_id % 5 + {FIRST_YEAR}) || ' Q' || (doc_id % 4 + 1) AS period, concat_ws(' ', source, 'FY' || (doc_id % 5 + {FIRST_YEAR}) || ' Q' || (doc_id % 4 + 1)) || chr(10) || text AS text FROM documents)"""
_TF = TF.replace(" AS toks FROM documents)", " AS toks FROM cx)").replace("SELECT item_id AS qid, text AS question FROM benchmark", "SELECT qid, expanded AS question FROM fx")


@query(f"WITH {ASKED} SELECT qid, array_to_string(tickers, ',') AS tickers, fiscal_year::VARCHAR AS fiscal_year, fiscal_quarter::VARCHAR AS fiscal_quarter, period_label, md5(expanded) AS expanded FROM fx")
def question_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and periods of questions, and how they are expanded."""
    rows = with_facets(_asked(spark, sf_dir), _dictionary(_docs(spark, sf_dir)))
    return rows.select("qid", F.array_join("tickers", ",").alias("tickers"), *[F.col(c).cast("string").alias(c) for c in ("fiscal_year", "fiscal_quarter")], "period_label", F.md5("expanded").alias("expanded"))


@query(
    f"""WITH {ASKED}, {_TF}, r0 AS (SELECT s.qid, s.doc_id, s.score, cx.source AS ticker, fl.tickers, len(tickers) > 1 AS several, CASE WHEN len(tickers) > 1 THEN list_contains(tickers, cx.source) ELSE (len(tickers) <> 1 OR cx.source = tickers[1]) AND (fiscal_quarter IS NULL OR cx.period = period_label) END AS good FROM s JOIN cx USING (doc_id) JOIN fl USING (qid) WHERE s.score > 0),
r1 AS (SELECT *, bool_or(good) OVER (PARTITION BY qid) AS filtered FROM r0), r2 AS (SELECT *, CASE WHEN several AND filtered THEN ticker END AS "of" FROM r1 WHERE good OR NOT filtered), r3 AS (SELECT *, row_number() OVER (PARTITION BY qid, "of" ORDER BY score DESC, doc_id) AS position FROM r2)
SELECT qid, doc_id, ticker, row_number() OVER (PARTITION BY qid ORDER BY position, "of", doc_id)::INT AS rank, filtered FROM r3 QUALIFY rank <= 5"""
)
def filtered_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded questions over texts with their context, under the filters that they imply, companies taken in turn."""
    docs = _docs(spark, sf_dir)
    return retrieve(context_index(docs), with_facets(_asked(spark, sf_dir), _dictionary(docs)), 5).drop("score")


_TOPIC_SQL = " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{t}'" for t, p in TOPICS.items())


@query(
    rf"""WITH {ASKED}, cw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(source), '[a-z]{{3,}}')) AS word FROM documents), iq AS (SELECT DISTINCT qid FROM aq JOIN cw ON contains(lower(question), word)),
yr AS (SELECT qid, max(y::INT) AS last FROM (SELECT qid, unnest(regexp_extract_all(question, '{ANY_YEAR}', 1)) AS y FROM aq) GROUP BY qid)
SELECT qid, CASE {_TOPIC_SQL} WHEN regexp_matches(lower(question), '\b({'|'.join(OUTSIDERS)})\b') AND qid NOT IN (SELECT qid FROM iq) THEN 'outsider' WHEN qid IN (SELECT qid FROM iq) AND last < {FIRST_YEAR} THEN 'too early' END AS why FROM aq LEFT JOIN yr USING (qid)"""
)
def question_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What puts questions outside of the corpus."""
    outsiders = spark.createDataFrame(list(OUTSIDERS.items()), "word string, ticker string")
    return scope_check(_asked(spark, sf_dir), _docs(spark, sf_dir), outsiders)
