"""What a reader is shown of a passage: the rows of a table with its caption as a gold span, and the figures of an answer marked where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import figures as N
from lodestone.operators.parsing import document_lines, spread
from lodestone.registry import query, table

# What a table begins and ends with, lines of caption before it, and the tags around a marked figure.
TABLE, TABLE_END, CAPTION_LINES = "[TABLE]", "[/TABLE]", 2
OPEN, CLOSE = "<mark>", "</mark>"
DIGITS = r"[0-9][0-9,]*(?:\.[0-9]+)?"
#: Characters of a passage and of an excerpt that a response carries.
PASSAGE, EXCERPT = 2000, 300


def table_rows(docs: DataFrame, wanted: Column) -> DataFrame:
    """doc_id, line_no, start, end: a span for each line for which `wanted` (of `line`) holds.

    In a table the span begins at the table's mark, with up to CAPTION_LINES lines that are not empty before it, and ends with the line; elsewhere it
    is the line. A table that was never closed goes on to the end; lines of marks are no rows.
    """
    own = Window.partitionBy("doc_id").orderBy("line_no")
    full = Window.partitionBy("doc_id", F.trim("line") != "").orderBy("line_no")
    lines = document_lines(docs)
    mark = F.when(F.trim("line") == TABLE, F.col("start")).when(F.trim("line") == TABLE_END, -1)
    # where the lines of the caption begin that a table in this line would have
    before = F.coalesce(F.lag("start", CAPTION_LINES).over(full), F.first("start").over(full))
    opened = F.when(F.trim("line") == TABLE, before).when(F.trim("line") == TABLE_END, -1)
    rows = lines.withColumn("mark", F.last(mark, ignorenulls=True).over(own)).withColumn("opened", opened).withColumn("from", F.last("opened", ignorenulls=True).over(own))
    rows = rows.where(wanted & ~F.trim("line").isin(TABLE, TABLE_END))
    return rows.select("doc_id", "line_no", F.when(F.col("mark") >= 0, F.col("from")).otherwise(F.col("start")).alias("start"), (F.col("start") + F.length("line")).alias("end"))


def figures_to_mark(answer: Column, passage: Column) -> Column:
    """The digits of those figures of an answer that a passage states, each once, in the order of the answer; numbers of tags are none."""
    said = F.filter(N.amounts(N.strip_tags(F.coalesce(answer, F.lit("")))), lambda a: N.stated(a, N.amounts(F.coalesce(passage, F.lit(""))), N.caption_scale(passage)))
    return F.array_distinct(F.filter(F.transform(said, lambda a: F.regexp_extract(a["raw"], DIGITS, 0)), lambda d: d != ""))


def highlight(passage: Column, digits: Column) -> Column:
    """A passage as HTML with the figures marked: escaped first; the longest figure wins, and none is marked inside of a longer number."""
    text = F.coalesce(passage, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    longest = F.array_sort(digits, lambda a, b: F.length(b) - F.length(a))
    any_of = F.array_join(F.transform(longest, lambda d: F.replace(d, F.lit("."), F.lit("\\."))), "|")
    pattern = F.concat(F.lit(r"(?<![0-9,.])(?<!&#x)("), any_of, F.lit(r")(?![0-9]|[,.][0-9])"))
    return F.when(F.size(digits) > 0, F.regexp_replace(text, pattern, F.lit(f"{OPEN}$1{CLOSE}"))).otherwise(text)


def shown(text: Column, most: int = PASSAGE) -> Column:
    return F.substring(text, 1, most)


@query(
    r"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l1 AS (SELECT doc_id, line_no, CASE (doc_id + line_no) % 9 WHEN 3 THEN '[TABLE]' WHEN 7 THEN '[/TABLE]' WHEN 1 THEN '' ELSE line END AS line FROM l0), l AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM l1),
n AS (SELECT *, (SELECT min(start) FROM (SELECT start FROM l p WHERE p.doc_id = l.doc_id AND p.line_no < l.line_no AND trim(p.line) <> '' ORDER BY p.line_no DESC LIMIT 2)) AS cap FROM l WHERE trim(line) = '[TABLE]'),
o AS (SELECT l.*, (SELECT max(n.line_no) FROM n WHERE n.doc_id = l.doc_id AND n.line_no < l.line_no) AS opened, (SELECT max(e.line_no) FROM l e WHERE e.doc_id = l.doc_id AND e.line_no < l.line_no AND trim(e.line) = '[/TABLE]') AS closed FROM l)
SELECT o.doc_id, o.line_no, CASE WHEN opened > coalesce(closed, -1) THEN coalesce(n.cap, n.start) ELSE o.start END::BIGINT AS start, (o.start + length(o.line))::BIGINT AS "end" FROM o LEFT JOIN n ON n.doc_id = o.doc_id AND n.line_no = o.opened WHERE regexp_matches(o.line, 'th|de') AND trim(o.line) NOT IN ('[TABLE]', '[/TABLE]')"""
)
def table_row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the lines of documents, some of which are made marks of tables and empty lines."""
    show = F.expr("transform(split(text, '\\n'), (line, i) -> CASE (doc_id + i) % 9 WHEN 3 THEN '[TABLE]' WHEN 7 THEN '[/TABLE]' WHEN 1 THEN '' ELSE line END)")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(show, "\n").alias("text"))
    return table_rows(docs, F.col("line").rlike("th|de"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' &lt;of&gt; ' || o_custkey || ': <mark>' || format('{:,.2f}', o_totalprice) || '</mark> paid, 2.5 &amp; 77' AS html FROM orders")
def marked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages about orders with the figure that an answer takes from them marked."""
    price = F.format_number("o_totalprice", 2)
    passage = F.concat(F.lit("Order "), "o_orderkey", F.lit(" <of> "), "o_custkey", F.lit(": "), price, F.lit(" paid, 2.5 & 77"))
    answer = F.concat(F.lit("It came to "), price, F.lit(" [c1]."))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", passage.alias("passage"), answer.alias("answer")))
    rows = rows.select("*", figures_to_mark(F.col("answer"), F.col("passage")).alias("digits"))
    return rows.select("o_orderkey", highlight(F.col("passage"), F.col("digits")).alias("html"))
