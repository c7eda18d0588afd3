"""Pages and documents to canonical text, lines and sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.registry import query, table

# Elements that start a line, and those whose text is dropped.
BREAKS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table ul ol section article header footer nav title".split())
DROPPED = frozenset(("script", "style", "ix:header"))


def tidy(row: str) -> str:
    """What tidy_numbers does, for a row of a table."""
    return re.sub(r"([$(])\s+(?=[0-9.,])", r"\1", re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", row)))


#: Bytes of a batch that a Python function turns into objects at once.
SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about SLICE bytes, a row at least, so that what a function makes of them doesn't grow with a batch."""
    for batch in batches:
        n = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


class _Text(HTMLParser):
    """Gathers text, with a line break at each block element and tables as lines of cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.dropped = 0
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "table":
            self.parts.append("\n[TABLE]\n")
            self.rows = 0
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag in BREAKS and self.cell is None:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in ("td", "th") and self.cell is not None:
            cell = " ".join("".join(self.cell).split())
            if cell and self.row is not None:
                # a currency sign, bracket or percent sign in a cell of its own belongs to its neighbour
                if self.row and (cell in (")", "%", ")%") or self.row[-1] in ("$", "(", "$(")):
                    self.row[-1] += cell
                else:
                    self.row.append(cell)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.parts.append(("header: " if not self.rows else "") + tidy(" | ".join(self.row)) + "\n")
                self.rows += 1
            self.row = None
        elif tag == "table":
            self.parts.append("[/TABLE]\n")

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            (self.parts if self.cell is None else self.cell).append(data)


def page_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text and error: every page's canonical text, or what kept it from being parsed; no row is lost.

    html may be text or bytes; bytes are read as UTF-8 with replacement marks. A null page is an error ("no content"), an empty one an empty text.
    The normaliser is a Python function over Arrow batches, as no built-in parses HTML; an error stays with its row.
    """

    def one(page: str | bytes | None) -> tuple[str | None, str | None]:
        if page is None:
            return None, "no content"
        try:
            return page_text(page.decode("utf-8", "replace") if isinstance(page, bytes) else page), None
        except Exception as e:  # noqa: BLE001  whatever a page provokes is recorded with it
            return None, f"{type(e).__name__}: {e}"[:200]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [one(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())], [key, "text", "error"])

    return spread(pages.select(key, html)).mapInArrow(each, f"{key} {dict(pages.dtypes)[key]}, text string, error string")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows anew if their scan has fewer partitions than the cluster has cores, as with files of one row group."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parse_report(parsed: DataFrame, group: Column) -> DataFrame:
    """Of each group: pages, parsed, failed, and the failures by what they say."""
    n = parsed.groupBy(group.alias("of"), "error").agg(F.count(F.lit(1)).alias("n"))
    failed = F.filter(F.array_sort(F.collect_list(F.struct("error", "n"))), lambda x: x["error"].isNotNull())
    rows = n.groupBy("of").agg(F.sum("n").alias("pages"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("parsed"), failed.alias("failures"))
    return rows.select("of", "pages", "parsed", (F.col("pages") - F.col("parsed")).alias("failed"), "failures")


def pages_to_text(pages: DataFrame) -> DataFrame:
    """page_id and text of the pages that can be parsed."""
    return parse_pages(pages).where("error IS NULL").drop("error")


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), start (code points), line."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("doc_id", "line_no", start.alias("start"), "line")


def headed(lines: DataFrame) -> DataFrame:
    """Adds `head`: whether a line is a heading and not in a table, be it closed or not."""
    mark = F.when(F.trim("line") == "[TABLE]", True).when(F.trim("line") == "[/TABLE]", False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit(False))
    return lines.withColumn("head", T.is_heading(F.col("line")) & ~inside)


_FOUND = "array<struct<start: bigint, title: string>>"


def with_blocks(docs: DataFrame) -> DataFrame:
    """Adds `blocks` to docs (text): an array of block, start, end, title, cut at headings outside of tables; before the first heading the title is null.

    A fold over a row's own lines finds the headings, so a text stays in its row and nothing is shuffled; rows without an id, and equal
    rows, keep their own. A null text has no blocks, an empty one a block of no length.
    """

    def step(s: Column, line: Column) -> Column:
        bare = F.trim(line)
        inside = F.when(bare == "[TABLE]", True).when(bare == "[/TABLE]", False).otherwise(s["inside"])
        here = F.array(F.struct(s["off"].alias("start"), line.alias("title")))
        found = F.when(T.is_heading(line) & ~inside, F.concat(s["found"], here)).otherwise(s["found"])
        return F.struct((s["off"] + F.length(line) + 1).alias("off"), inside.alias("inside"), found.alias("found"))

    begin = F.struct(F.lit(0).cast("long").alias("off"), F.lit(False).alias("inside"), F.array().cast(_FOUND).alias("found"))
    rows = docs.withColumn("_heads", F.aggregate(T.lines(F.coalesce("text", F.lit(""))), begin, step, lambda s: s["found"]))
    first = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("title")))
    led = F.coalesce(F.get("_heads", 0)["start"] == 0, F.lit(False))
    rows = rows.withColumn("_led", led).withColumn("_heads", F.when(led, F.col("_heads")).otherwise(F.concat(first, F.col("_heads"))))

    def block(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_heads", i + 1)["start"] - 1, F.length("text").cast("long"))
        return F.struct((i + F.col("_led").cast("int")).alias("block"), h["start"].alias("start"), end.alias("end"), h["title"].alias("title"))

    found = F.when(F.col("text").isNotNull(), F.transform("_heads", block)).otherwise(F.array().cast("array<struct<block: int, start: bigint, end: bigint, title: string>>"))
    return rows.withColumn("blocks", found).drop("_heads", "_led")


def unfolded(name: str) -> Column:
    """The rows of an array of structs that a fold over their row has made.

    Of a bare column, Spark infers a filter on the array's size, and pushes it below the projections and the exchange with the fold
    written out in it, once for each use of it, so also once for each element. Of an expression it infers none.
    """
    return F.inline(F.transform(name, lambda x: x))


def sections(docs: DataFrame) -> DataFrame:
    """Blocks between headings: doc_id, block, start, end, title (null before the first heading)."""
    return with_blocks(spread(docs.select("doc_id", "text"))).select("doc_id", unfolded("blocks"))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars >= 200").select("doc_id", "source", "lang", "n_chars")


@query()
def page_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_text(table(spark, sf_dir, "pages"))


BROKEN = 17


@query(
    rf"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (page_id % {BROKEN} <> 0) AS parsed, count(*) FILTER (page_id % {BROKEN} = 0) AS failed, "
    rf"CASE WHEN count(*) FILTER (page_id % {BROKEN} = 0) > 0 THEN 'no content' ELSE '' END AS errors FROM pages GROUP BY 1"
)
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parse run reports of each host, if every BROKEN-th page came without content."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % BROKEN != 0, F.col("html")))
    parsed = parse_pages(pages).join(pages.select("page_id", "url"), "page_id")
    rows = parse_report(parsed, F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return rows.select(F.col("of").alias("host"), "pages", "parsed", "failed", F.array_join("failures.error", ";").alias("errors"))


@query(
    r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ')) AS digest FROM documents"
)
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '([$(])\s+([0-9.,])', '\1\2', 'g')) AS digest FROM documents")
def tidy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy_numbers(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))


LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, line FROM l0)"""
HEADS = r"""h AS (SELECT l.*, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 8
  AND regexp_matches(line, '^\s*[A-Z(]') AND NOT regexp_matches(line, '[.:;,]\s*$') AND NOT contains(line, '|') AS head FROM l)"""
BLOCKS = """b0 AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM h),
b AS (SELECT doc_id, block::INT AS block, min(start) AS start, max(start + length(line)) AS "end", min(CASE WHEN head THEN line END) AS title FROM b0 GROUP BY doc_id, block)"""


@query(f"WITH {LINES} SELECT doc_id, line_no, start, line FROM l WHERE trim(line) <> ''")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")


@query(f"WITH {LINES}, {HEADS} SELECT doc_id, line_no, line FROM h WHERE head")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headed(document_lines(table(spark, sf_dir, "documents"))).where("head").select("doc_id", "line_no", "line")


@query(f'WITH {LINES}, {HEADS}, {BLOCKS} SELECT doc_id, block, start, "end", title FROM b')
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(table(spark, sf_dir, "documents"))


@query(
    f"WITH {LINES}, {HEADS}, s AS (SELECT doc_id, start, line AS title, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next FROM h WHERE head) "
    r"""SELECT s.doc_id, s.title, s.start, (s.start + length(regexp_replace(substring(d.text, s.start + 1, coalesce(s.next, d.n_chars) - s.start), '\s+$', '')))::BIGINT AS "end" FROM s JOIN documents d USING (doc_id)"""
)
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading's section up to the next heading or the end, without the white space at its end."""
    docs = table(spark, sf_dir, "documents")
    heads = headed(document_lines(docs)).where("head")
    following = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
    heads = heads.select("doc_id", F.col("line").alias("title"), "start", following.alias("next"))
    rows = heads.join(docs.select("doc_id", "text", "n_chars"), "doc_id")
    body = F.substring("text", F.col("start").cast("int") + 1, (F.coalesce("next", "n_chars") - F.col("start")).cast("int"))
    end = F.col("start") + F.length(F.regexp_replace(body, r"\s+\z", ""))
    return rows.select("doc_id", "title", "start", end.alias("end"))


@query(
    "WITH e AS (SELECT DISTINCT s.source, l.lang FROM documents s, (SELECT DISTINCT lang FROM documents) l), f AS (SELECT DISTINCT source, lang FROM documents) "
    "SELECT e.source, count(f.lang) AS found, count(*) - count(f.lang) AS missing, bool_and(f.lang IS NOT NULL OR e.lang <> 'en') AS ok FROM e LEFT JOIN f ON e.source = f.source AND e.lang = f.lang GROUP BY e.source"
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and missing items of each group against the expected set; English is critical."""
    found = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    wanted = found.agg(F.collect_set("lang").alias("wanted"))
    have = found.groupBy("source").agg(F.collect_set("lang").alias("have")).join(F.broadcast(wanted))
    missing = F.array_except("wanted", "have")
    return have.select("source", F.size("have").cast("long").alias("found"), F.size(missing).cast("long").alias("missing"), (~F.array_contains(missing, "en")).alias("ok"))
