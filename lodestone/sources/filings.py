"""Listings of filings: selection, manifests, fiscal periods and labels, over the tables that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.registry import query, table


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the last written."""
    own = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def explode_listing(listing: DataFrame, columns: list[str]) -> DataFrame:
    """A struct of parallel arrays, as listings are served, to rows."""
    return listing.select("*", F.inline(F.arrays_zip(*columns))).drop()


def fiscal_period(report: Column, year_end: Column, annual: Column) -> tuple[Column, Column]:
    """Fiscal year and quarter of a report date, for a year that ends on MMDD; ten days' tolerance, no quarter for annual reports."""
    month, day = F.substring(year_end, 1, 2).cast("int"), F.substring(year_end, 3, 2).cast("int")
    ends = lambda y: F.coalesce(F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd"), F.make_date(y, month, F.lit(28)))
    this = ends(F.year(report))
    year = F.when(report <= F.date_add(this, 10), F.year(report)).otherwise(F.year(report) + 1)
    days = F.datediff(report, ends(year - 1))
    quarter = F.greatest(F.lit(1), F.least(F.lit(4), F.round(days / F.lit(91.3125)).cast("int")))
    return year, F.when(~annual, quarter)


@query(
    "WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, list(o_orderpriority ORDER BY o_orderkey) AS forms, list(o_orderdate ORDER BY o_orderkey) AS dates FROM orders GROUP BY o_custkey), "
    "x AS (SELECT o_custkey, unnest(keys) AS o_orderkey, unnest(forms) AS form, unnest(dates) AS filed FROM o) SELECT o_custkey, o_orderkey, form, strftime(filed, '%Y-%m-%d') AS filed FROM x WHERE form IN ('1-URGENT', '2-HIGH') AND filed >= TIMESTAMP '1995-01-01'"
)
def edgar_page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as parallel arrays, one per company, back to rows, filtered by form and date."""
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderdate")))
    page = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    page = page.select("o_custkey", F.col("r.o_orderkey").alias("o_orderkey"), F.col("r.o_orderpriority").alias("form"), F.col("r.o_orderdate").alias("filed"))
    found = page.select("o_custkey", F.inline(F.arrays_zip("o_orderkey", "form", "filed")))
    found = found.where(F.col("form").isin("1-URGENT", "2-HIGH") & (F.col("filed") >= F.lit("1995-01-01").cast("timestamp")))
    return found.select("o_custkey", "o_orderkey", "form", F.date_format("filed", "yyyy-MM-dd").alias("filed"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'cached' WHEN l.doc_id IS NOT NULL THEN 'recorded' ELSE 'download' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest does with each document, given those it knows."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    status = F.when(F.col("known") & (F.col("quality") == 1), "cached").when(F.col("known"), "recorded").otherwise("download")
    return rows.select("doc_id", status.alias("status"))


YEAR_ENDS = ("0926", "0131", "1231", "0630", "0229")


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS report, [{', '.join(f"'{y}'" for y in YEAR_ENDS)}][(o_custkey % 5 + 1)::INT] AS fye, o_orderpriority = '1-URGENT' AS annual FROM orders),
    e AS (SELECT *, substring(fye, 1, 2)::INT AS mm, substring(fye, 3, 2)::INT AS dd FROM o), f AS (SELECT *, coalesce(try_strptime(year(report)::VARCHAR || fye, '%Y%m%d')::DATE, make_date(year(report), mm, 28)) AS this FROM e),
    g AS (SELECT *, CASE WHEN report <= this + 10 THEN year(report) ELSE year(report) + 1 END AS fy FROM f), h AS (SELECT *, coalesce(try_strptime((fy - 1)::VARCHAR || fye, '%Y%m%d')::DATE, make_date(fy - 1, mm, 28)) AS prev FROM g)
    SELECT o_orderkey, 'FY' || fy || CASE WHEN annual THEN '' ELSE ' Q' || greatest(1, least(4, round(date_diff('day', prev, report) / 91.3125::DOUBLE)::INT)) END AS period_label FROM h"""
)
def fiscal_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal labels of order dates, with a year end that the customer sets."""
    rows = table(spark, sf_dir, "orders").withColumn("report", F.to_date("o_orderdate"))
    end = F.element_at(F.array(*[F.lit(y) for y in YEAR_ENDS]), (F.col("o_custkey") % 5 + 1).cast("int"))
    year, quarter = fiscal_period(F.col("report"), end, F.col("o_orderpriority") == "1-URGENT")
    label = F.concat(F.lit("FY"), year, F.coalesce(F.concat(F.lit(" Q"), quarter), F.lit("")))
    return rows.select("o_orderkey", label.alias("period_label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'Part ' || CASE WHEN l_linenumber <= 4 THEN 'I' ELSE 'II' END || '.Item ' || l_linenumber ELSE 'Item ' || l_linenumber END AS section FROM lineitem")
def section_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_linenumber") <= 4, "I").otherwise("II")
    item = F.concat(F.lit("Item "), "l_linenumber")
    key = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Part "), part, F.lit("."), item)).otherwise(item)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("section"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', '') AS path FROM pages")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of each page's address."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/?#]+", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), path.alias("path"))
