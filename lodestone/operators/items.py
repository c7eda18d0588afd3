"""Items of filings: a walk over the lines of a text that carries the part, the table and what was found so far.

The walk is two folds over arrays of a row: one gathers the few lines that can matter, with exact offsets, the other carries the state over
them. So a text is never exploded and nothing is shuffled; a filing with its sections stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.parsing import spread, unfolded
from lodestone.registry import query, table

# What begins a heading line, what may follow a part's numeral, the most words of a heading.
ITEM = r"(?iU)item\s*(\d{1,2})\s*([a-c]?)\s*[-.:–—]?\s+(\S.*)"
PART = r"(?iU)part\s+(iii|ii|iv|i)\b\s*(.*)"
AFTER_PART, HEADING_WORDS = r"[ –—‐:.\-]", 25
SIGNATURE, TABLE, TABLE_END = r"(?i)signatures?", "[TABLE]", "[/TABLE]"
NUMERALS = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
# Items of a form by part, and those without which a parse has failed.
EXPECTED = {
    "10-K": {1: "1 1A 1B 1C 2 3 4", 2: "5 6 7 7A 8 9 9A 9B 9C", 3: "10 11 12 13 14", 4: "15 16"},
    "10-Q": {1: "1 2 3 4", 2: "1 1A 2 3 4 5 6"},
}
CRITICAL = {"10-K": {1: "1 1A", 2: "7 7A 8"}, "10-Q": {1: "1 2", 2: "1A"}}

_MARKS = "array<struct<at: int, size: int, line: string>>"
_HEADS = "array<struct<part: int, item: string, title: string, start: int, body: int>>"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _anchored(pattern: str) -> str:
    flags, rest = pattern.split(")", 1)
    return rf"{flags})\A(?:{rest})\z"


def _whole(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(line, _anchored(pattern), group)


def _is(line: Column, pattern: str) -> Column:
    return line.rlike(_anchored(pattern))


def marks(text: Column) -> Column:
    """Lines that can be an item, a part, a signature or a table mark: at (code points), size, line without white space around it."""
    may = lambda line: line.rlike(r"(?iU)\A\s*(item|part|signature|\[/?table\])")

    def step(state: Column, line: Column) -> Column:
        one = F.array(F.struct(state["off"].alias("at"), F.length(line).alias("size"), strip(line).alias("line")))
        return F.struct((state["off"] + F.length(line) + 1).alias("off"), F.when(may(line), F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    begin = F.struct(F.lit(0).alias("off"), F.array().cast(_MARKS).alias("found"))
    return F.aggregate(F.split(text, "\n"), begin, step, lambda s: s["found"])


def headings(found: Column, size: Column) -> Column:
    """heads (part, item, title, start, body) in order, and signed: where the signatures begin, `size` if nowhere."""

    def step(s: Column, m: Column) -> Column:
        line = m["line"]
        inside = F.when(line == TABLE, True).when(line == TABLE_END, False).otherwise(s["inside"])
        rest = strip(_whole(line, PART, 2))
        is_part = _is(line, PART) & ((rest == "") | rest.rlike(rf"\A{AFTER_PART}"))
        numeral = F.lower(_whole(line, PART, 1))
        part = F.coalesce(*[F.when(numeral == k, v) for k, v in NUMERALS.items()])
        shown = F.when(is_part, F.regexp_replace(rest, rf"\A{AFTER_PART}+", "")).otherwise(line)
        words = F.size(F.filter(F.split(shown, r"(?U)\s+"), lambda w: w != ""))
        is_item = _is(shown, ITEM) & (words <= HEADING_WORDS)
        now = F.when(is_part, part).otherwise(s["part"])
        head = F.struct(
            now.alias("part"), F.concat(_whole(shown, ITEM, 1), F.upper(_whole(shown, ITEM, 2))).alias("item"), strip(_whole(shown, ITEM, 3)).alias("title"),
            m["at"].alias("start"), (m["at"] + m["size"] + 1).alias("body"),
        )
        signed = F.when((F.size(s["heads"]) > 0) & _is(line, SIGNATURE), F.least(s["signed"], m["at"])).otherwise(s["signed"])
        heads = F.when(is_item, F.concat(s["heads"], F.array(head))).otherwise(s["heads"])
        keep = lambda new, old: F.when(inside, old).otherwise(new)
        return F.struct(keep(now, s["part"]).alias("part"), inside.alias("inside"), keep(signed, s["signed"]).alias("signed"), keep(heads, s["heads"]).alias("heads"))

    begin = F.struct(F.lit(0).alias("part"), F.lit(False).alias("inside"), size.alias("signed"), F.array().cast(_HEADS).alias("heads"))
    return F.aggregate(found, begin, step, lambda s: F.struct(s["heads"].alias("heads"), s["signed"].alias("signed")))


def with_sections(filings: DataFrame, text: str = "text") -> DataFrame:
    """Adds `sections`: array of part (0 before any part line), item, title, start, end, in the order of the text.

    A heading is a line outside tables that begins with an item's number, has a title and at most HEADING_WORDS words, alone or after a part
    on the same line. A line `Part I, Item 1 of ...` is a reference and leaves the part alone. A section ends where the next one
    begins, the last one where the signatures do, without white space at its end; signatures before the last heading leave it
    empty. A null text has no sections (an empty array). All columns stay; equal rows stay apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = filings.withColumn("_h", headings(marks(body), F.length(body)))
    n = F.size("_h.heads")

    def section(h: Column, i: Column) -> Column:
        following = F.when(i + 1 < n, F.get("_h.heads", i + 1)["start"]).otherwise(F.col("_h.signed"))
        stop = F.greatest(h["start"], F.least(following, F.length(body)))
        stop = F.when((i + 1 == n) & (F.col("_h.signed") > h["start"]), F.greatest(stop, h["body"])).otherwise(stop)
        end = h["start"] + F.length(F.regexp_replace(F.substring(body, h["start"] + 1, stop - h["start"]), r"(?U)\s+\z", ""))
        return F.struct(h["part"].alias("part"), h["item"].alias("item"), h["title"].alias("title"), h["start"].alias("start"), end.alias("end"))

    return rows.withColumn("sections", F.transform("_h.heads", section)).drop("_h")


def key(part: Column, item: Column) -> Column:
    """`Part II.Item 1A`, or `Item 7` where no part is known."""
    numeral = F.coalesce(*[F.when(part == n, name.upper()) for name, n in NUMERALS.items()])
    return F.concat(F.coalesce(F.concat(F.lit("Part "), numeral, F.lit(".")), F.lit("")), F.lit("Item "), item)


def _items(forms: dict[str, dict[int, str]], form: Column) -> Column:
    """The items of a form as sorted keys `part item`, none for an unknown form."""
    made = F.lit(None)
    for name, parts in forms.items():
        made = F.when(F.upper(form) == name, F.array(*[F.lit(f"{p} {i}") for p, items in parts.items() for i in items.split()])).otherwise(made)
    return F.coalesce(made, F.array().cast("array<string>"))


def with_coverage(filings: DataFrame, form: str = "form") -> DataFrame:
    """Adds found, missing, missing_critical, unexpected (arrays of `part item`) and ok to rows with sections; a form without a list expects nothing."""
    found = F.array_sort(F.array_distinct(F.transform("sections", lambda s: F.concat_ws(" ", s["part"], s["item"]))))
    expected, critical = _items(EXPECTED, F.col(form)), _items(CRITICAL, F.col(form))
    unexpected = F.when(F.size(expected) > 0, F.array_except("found", expected)).otherwise(F.array().cast("array<string>"))
    rows = filings.withColumn("found", found).withColumn("missing", F.array_except(expected, "found")).withColumn("missing_critical", F.array_except(critical, "found"))
    return rows.withColumn("unexpected", unexpected).withColumn("ok", F.size("missing_critical") == 0)


#: Lines that a derived filing shows, by the rest of 31 doc_id + 7 line_no over 16; other lines are the document's own.
SHOWN = {
    0: "'Part I'", 1: "'PART II - Other Information'", 2: "concat('Item 1. ', line)", 3: "'Item 1A. Risk Factors'", 4: "concat('Part I, Item 1A of the last report ', line)", 5: "'[TABLE]'",
    6: "'[/TABLE]'", 7: "'  item 7 Management Discussion '", 8: "'SIGNATURES'", 9: "'part ii: Item 2 - Properties'", 10: "'ITEM 9b: Other'", 11: "concat('Item 8 ', left(line, 40))", 12: "'Part IV Item 15. Exhibits'",
}
_SHOWN = "CASE (31 * doc_id + 7 * line_no) % 16 " + " ".join(f"WHEN {k} THEN {v}" for k, v in SHOWN.items()) + " ELSE line END"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing for each document: its lines, some in the guise of parts, items, references, tables and signatures; doc_id, form, text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    show = F.expr(f"transform(split(text, '\\n'), (line, line_no) -> {_SHOWN})")
    form = F.when(F.col("doc_id") % 3 == 0, "10-K").when(F.col("doc_id") % 3 == 1, "10-q").otherwise("8-K")
    return docs.select("doc_id", form.alias("form"), F.array_join(show, "\n").alias("text"))


# The same walk as windows over lines.
WALK = rf"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l1 AS (SELECT doc_id, line_no, {_SHOWN} AS line FROM l0),
l2 AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::INT AS start, trim(line, E' \t\r\v\f') AS t FROM l1),
sz AS (SELECT doc_id, max(start + length(line))::INT AS size FROM l2 GROUP BY doc_id),
l3 AS (SELECT *, coalesce(last_value(CASE t WHEN '[TABLE]' THEN true WHEN '[/TABLE]' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS inside, lower(regexp_extract(t, '(?i)^part\s+(iii|ii|iv|i)\b', 1)) AS num, trim(regexp_extract(t, '(?i)^part\s+(?:iii|ii|iv|i)\b\s*(.*)$', 1)) AS rest FROM l2),
l4 AS (SELECT *, num <> '' AND (rest = '' OR regexp_matches(rest, '^[ –—‐:.\-]')) AS is_part FROM l3 WHERE NOT inside),
l5 AS (SELECT *, CASE WHEN is_part THEN regexp_replace(rest, '^[ –—‐:.\-]+', '') ELSE t END AS shown, coalesce(last_value(CASE WHEN is_part THEN CASE num WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 ELSE 4 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS part FROM l4),
l6 AS (SELECT *, regexp_matches(shown, '(?i)^item\s*(\d{{1,2}})\s*([a-c]?)\s*[-.:–—]?\s+(\S.*)$') AND len(list_filter(regexp_split_to_array(shown, '\s+'), lambda w: w <> '')) <= 25 AS head FROM l5),
sg AS (SELECT l6.doc_id, min(l6.start) AS signed FROM l6 JOIN (SELECT doc_id, min(start) AS first FROM l6 WHERE head GROUP BY doc_id) f ON f.doc_id = l6.doc_id AND l6.start > f.first WHERE regexp_matches(t, '(?i)^signatures?$') GROUP BY l6.doc_id),
h AS (SELECT doc_id, part, regexp_extract(shown, '(?i)^item\s*(\d{{1,2}})', 1) || upper(regexp_extract(shown, '(?i)^item\s*\d{{1,2}}\s*([a-c]?)\s*[-.:–—]?\s+\S', 1)) AS item, trim(regexp_extract(shown, '(?i)^item\s*\d{{1,2}}\s*[a-c]?\s*[-.:–—]?\s+(\S.*)$', 1)) AS title, start, start + length(line) + 1 AS body, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next FROM l6 WHERE head),
tx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l1 GROUP BY doc_id),
e AS (SELECT h.*, tx.text, CASE WHEN next IS NULL AND coalesce(signed, size) > start THEN greatest(greatest(start, least(coalesce(next, signed, size), size)), body) ELSE greatest(start, least(coalesce(next, signed, size), size)) END AS stop FROM h JOIN sz USING (doc_id) JOIN tx USING (doc_id) LEFT JOIN sg USING (doc_id)),
s AS (SELECT doc_id, part, item, title, start, (start + length(regexp_replace(substring(text, start + 1, stop - start), '\s+$', '')))::INT AS "end" FROM e)"""


@query(f"WITH {WALK} SELECT doc_id, part, item, title, start FROM h")
def filing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item headings with the part that holds where they stand."""
    return with_sections(filings(spark, sf_dir)).select("doc_id", unfolded("sections")).drop("end")


@query(f"""WITH {WALK} SELECT s.doc_id, CASE WHEN part > 0 THEN 'Part ' || ['I', 'II', 'III', 'IV'][part] || '.' ELSE '' END || 'Item ' || item AS section, start, "end", md5(substring(text, start + 1, "end" - start)) AS digest FROM s JOIN tx USING (doc_id)""")
def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of filings with their offsets and a digest of what stands there."""
    rows = with_sections(filings(spark, sf_dir)).select("doc_id", "text", unfolded("sections"))
    body = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("doc_id", key(F.col("part"), F.col("item")).alias("section"), "start", "end", F.md5(body).alias("digest"))


def _values(forms: dict[str, dict[int, str]]) -> str:
    return ", ".join(f"('{form}', '{p} {i}')" for form, parts in forms.items() for p, items in parts.items() for i in items.split())


_LIST = "coalesce(list_sort(list({0}.k) FILTER ({0}.k IS NOT NULL)), [])"


@query(
    f"""WITH {WALK}, ex(form, k) AS (VALUES {_values(EXPECTED)}), cr(form, k) AS (VALUES {_values(CRITICAL)}),
fo AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form FROM documents), fd AS (SELECT DISTINCT doc_id, part || ' ' || item AS k FROM s),
mi AS (SELECT doc_id, list_sort(list(ex.k)) AS ks FROM fo JOIN ex USING (form) ANTI JOIN fd USING (doc_id, k) GROUP BY doc_id), mc AS (SELECT doc_id, list_sort(list(cr.k)) AS ks FROM fo JOIN cr USING (form) ANTI JOIN fd USING (doc_id, k) GROUP BY doc_id),
un AS (SELECT doc_id, list_sort(list(fd.k)) AS ks FROM fd JOIN fo USING (doc_id) ANTI JOIN ex USING (form, k) WHERE form <> '8-K' GROUP BY doc_id), al AS (SELECT doc_id, list_sort(list(k)) AS ks FROM fd GROUP BY doc_id)
SELECT fo.doc_id, coalesce(array_to_string(al.ks, ','), '') AS found, coalesce(array_to_string(mi.ks, ','), '') AS missing, coalesce(array_to_string(mc.ks, ','), '') AS missing_critical, coalesce(array_to_string(un.ks, ','), '') AS unexpected, mc.ks IS NULL AS ok
FROM fo LEFT JOIN al USING (doc_id) LEFT JOIN mi USING (doc_id) LEFT JOIN mc USING (doc_id) LEFT JOIN un USING (doc_id)"""
)
def filing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filing holds and lacks of its form's items."""
    rows = with_coverage(with_sections(filings(spark, sf_dir)))
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("found", "missing", "missing_critical", "unexpected")]
    return rows.select("doc_id", *joined, "ok")
