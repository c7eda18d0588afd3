"""Landed company listings: one JSON document a company, its recent filings as parallel arrays, older ones in pages of their own."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query, table
from lodestone.storage import shared_root

# The names of a listing's fields and the address of a filing.
ARRAYS = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
_PAGE = ", ".join(f"{a}: array<string>" for a in ARRAYS)
LISTING = f"cik string, name string, fiscalYearEnd string, filings struct<recent: struct<{_PAGE}>, files: array<struct<name: string, filingFrom: string, filingTo: string>>>"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
CONTACT, PLACEHOLDERS = r"[^@\s]+@[^@\s]+\.[^@\s]+", ("example.com", "example.org", "your-email", "your.name")


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """ticker (upper case), cik, name of a company list: one JSON document, an entry per number."""
    entries = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, struct<cik_str: long, ticker: string, title: string>>")).alias("n", "e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"), F.col("e.title").alias("name"))


def listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING).option("multiLine", True).json(path)


def companies(listed: DataFrame) -> DataFrame:
    """cik, name, fiscal_year_end (MMDD, empty if it is not given)."""
    return listed.select(F.col("cik").cast("long").alias("cik"), "name", F.coalesce("fiscalYearEnd", F.lit("")).alias("fiscal_year_end"))


def source_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def _rows(pages: DataFrame) -> DataFrame:
    """cik and a row for each place of the arrays of `page`."""
    return pages.select("cik", F.inline(F.arrays_zip(*[F.col(f"page.{a}").alias(a) for a in ARRAYS])))


def filings(spark: SparkSession, listed: DataFrame, folder: str, forms: Sequence[str], since: str) -> DataFrame:
    """cik, form, accession, filing_date, report_date, primary_document, source_url of filings of the forms since a day (ISO).

    Rows without a report date are left out. Extra pages (files of the folder) are read for companies whose recent filings all lie after `since`
    only, and of these the pages that reach it; where no company needs one, no page is read. Order them by filing_date, accession.
    """
    own = listed.select(F.col("cik").cast("long").alias("cik"), F.col("filings.recent").alias("page"), F.col("filings.files").alias("files"))
    older = own.where(F.lit(since) < F.array_min("page.filingDate")).select("cik", F.explode("files").alias("f")).where(F.col("f.filingTo") >= since)
    wanted = older.select("cik", F.col("f.name").alias("file")).distinct()
    names = [r.file for r in wanted.select("file").distinct().collect()]  # names of files, as many as a scan lists
    found = _rows(own)
    if names:
        pages = spark.read.schema(_PAGE.replace(": ", " ")).option("multiLine", True).json([f"{folder}/{n}" for n in names])
        pages = pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.struct(*ARRAYS).alias("page"))
        found = found.unionByName(_rows(pages.join(wanted, "file").select("cik", "page")))
    return _selected(found, forms, since)


def select(listed: DataFrame, pages: DataFrame, forms: Sequence[str], since: str) -> DataFrame:
    """filings() where the pages (cik, page) are a table: those of companies that need none are left by a semi-join."""
    own = listed.select(F.col("cik").cast("long").alias("cik"), F.col("filings.recent").alias("page"), F.col("filings.files").alias("files"))
    need = own.where((F.lit(since) < F.array_min("page.filingDate")) & F.exists("files", lambda f: f["filingTo"] >= since)).select("cik")
    return _selected(_rows(own).unionByName(_rows(pages.join(need, "cik", "left_semi"))), forms, since)


def _selected(found: DataFrame, forms: Sequence[str], since: str) -> DataFrame:
    found = found.where(F.col("form").isin(*forms) & (F.col("filingDate") >= since) & (F.coalesce("reportDate", F.lit("")) != ""))
    return found.select(
        "cik", "form", F.col("accessionNumber").alias("accession"), F.to_date("filingDate").alias("filing_date"), F.to_date("reportDate").alias("report_date"), F.col("primaryDocument").alias("primary_document"),
        source_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("source_url"),
    )


def check_user_agent(agent: str) -> str:
    """The agent without white space around it; one without an address of contact, or with a made-up one, is a ValueError."""
    agent = agent.strip()
    if not re.search(CONTACT, agent) or any(p in agent.lower() for p in PLACEHOLDERS):
        raise ValueError(f"the user agent needs a real contact: {agent!r}")
    return agent


SINCE, RECENT, FORMS = "1994-06-01", 4, ("1-URGENT", "2-HIGH")


@query(
    rf"""WITH o AS (SELECT o_custkey AS cik, o_orderkey, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders)
SELECT cik, form, 'A-' || o_orderkey AS accession, filed AS filing_date, '{ARCHIVE}/' || cik || '/A' || o_orderkey || '/d.htm' AS source_url FROM o WHERE form IN ('1-URGENT', '2-HIGH') AND filed >= '{SINCE}' AND o_orderkey % 5 <> 0"""
)
def listing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as listings of customers, the RECENT latest in the listing and the others in a page, every fifth without a report date; and what a scan selects."""
    folder = f"{shared_root(spark)}/listings-{uuid.uuid4().hex}"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    report = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(day)
    one = F.struct(day.alias("filingDate"), F.concat(F.lit("A-"), "o_orderkey").alias("accessionNumber"), F.col("o_orderpriority").alias("form"), report.alias("reportDate"), F.lit("d.htm").alias("primaryDocument"))
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.reverse(F.array_sort(F.collect_list(one))).alias("all"))
    page = lambda rows: F.struct(*[rows.getField(a).alias(a) for a in ARRAYS])
    old = F.slice("all", RECENT + 1, 1_000_000)
    file = F.struct(F.concat(F.lit("cik="), "cik").alias("name"), F.element_at(old, -1)["filingDate"].alias("filingFrom"), F.get(old, 0)["filingDate"].alias("filingTo"))
    files = F.when(F.size("all") > RECENT, F.array(file)).otherwise(F.array().cast("array<struct<name: string, filingFrom: string, filingTo: string>>"))
    listed = per.select("cik", F.concat(F.lit("C"), "cik").alias("name"), F.lit("1231").alias("fiscalYearEnd"), F.struct(page(F.slice("all", 1, RECENT)).alias("recent"), files.alias("files")).alias("filings"))
    listed.write.json(f"{folder}/listed")
    # all pages of a scan lie in one file here: a reader of pages by name would list a file for each customer
    per.where(F.size("all") > RECENT).select("cik", page(old).alias("page")).write.json(f"{folder}/pages")
    read = spark.read.schema(LISTING).json(f"{folder}/listed")
    found = select(read, spark.read.schema(f"cik long, page struct<{_PAGE}>").json(f"{folder}/pages"), FORMS, SINCE)
    return found.select("cik", "form", "accession", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "source_url")
