"""Licence scans: lines and whole texts against licence notices by the Dice coefficient over word bigrams, natively."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fold
from lodestone.llm.license_texts import BODIES

# Customary notices of well-known public licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
THRESHOLD = 0.8


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text: lower case A-Z, punctuation as spaces."""
    return F.array_distinct(F.array_compact(neighbours(words_of(text))))


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(fold(text), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ")), " ")


def neighbours(words: Column) -> Column:
    """The pairs of neighbouring words in order, and a null for the last word."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), lambda a, b: F.concat(a, F.lit(" "), b))


def templates(spark: SparkSession, notices: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per template and bigram: template number, license, number of its bigrams, bigram."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(notices)], "template int, license string, notice string")
    rows = rows.withColumn("own", bigrams(F.col("notice")))
    return rows.select("template", "license", F.size("own").alias("template_size"), F.explode("own").alias("bigram"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, notices: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every line, and every text of several lines as a whole (line_no 0), that matches a notice.

    Columns: doc_id, line_no (from 1), line, license, template, dice. Dice is 2 |A and B| / (|A| + |B|) over distinct
    bigrams, so only sizes within threshold/(2 - threshold) times a template's, or its inverse, are compared;
    a bound on characters prunes before any bigram is made. Null and empty texts match nothing; repeated
    rows give a match each, as lines are told apart by the row's own number; ties of templates are all
    returned. Templates (some hundred bigrams) are broadcast: they are a fixed list, whatever the input.
    """
    known = templates(docs.sparkSession, notices)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [row[0] for row in known.select("template_size").distinct().collect()]
    least, most = low * (min(sizes) or 1), high * max(sizes)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "line")
    whole = docs.where(F.instr(text, "\n") > 0).select("doc_id", F.lit(0).alias("line_no"), text.alias("line"))
    units = lines.unionByName(whole)
    # n bigrams need n + 1 words, so 2 n + 1 characters at least
    units = units.where(F.length("line") >= F.lit(2 * least + 1)).withColumn("own", bigrams(F.col("line"))).withColumn("own_size", F.size("own"))
    units = units.where(F.col("own_size").between(F.lit(least), F.lit(most))).withColumn("unit", F.monotonically_increasing_id())
    pairs = units.select("doc_id", "line_no", "line", "unit", "own_size", F.explode("own").alias("bigram"))
    pairs = pairs.join(F.broadcast(known), "bigram")
    pairs = pairs.where(F.col("own_size").between(F.col("template_size") * low, F.col("template_size") * high))
    shared = pairs.groupBy("unit", "doc_id", "line_no", "line", "own_size", "template", "license", "template_size").agg(F.count(F.lit(1)).alias("n"))
    dice = F.lit(2.0) * F.col("n") / (F.col("own_size") + F.col("template_size"))
    return shared.select("doc_id", "line_no", "line", "license", "template", F.round(dice, 6).alias("dice")).where(F.col("dice") >= threshold)


def _shapes(spark: SparkSession, threshold: float, notices: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row per template: its bigrams, how many a match shares at least, bigrams and words of which a match has one, and the run lengths."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(notices)], "template int, license string, notice string")
    made = []
    for r in rows.withColumn("own", bigrams(F.col("notice"))).collect():
        n = len(r.own)
        # the run's own bigrams number as many as are shared at least, so 2 s / (s + n) >= threshold bounds s
        least = math.ceil(n * threshold / (2 - threshold) - 1e-9)
        # with all but least - 1 bigrams listed, a match has a listed one; the longest words are the rarest
        listed = sorted(r.own, key=lambda b: (-max(map(len, b.split())), b))[: n - least + 1]
        signs = sorted({max(b.split(), key=len) for b in listed})
        step = max(1, n // 16)
        sizes = sorted({*range(least, math.floor(n * (2 - threshold) / threshold + 1e-9) + 1, step), n})
        made.append((r.template, r.license, r.own, n, least, listed, signs, sizes))
    return spark.createDataFrame(made, "template int, license string, known array<string>, n int, least int, listed array<string>, signs array<string>, sizes array<int>")


def passages(docs: DataFrame, threshold: float = THRESHOLD, notices: tuple[tuple[str, str], ...] = TEMPLATES + BODIES) -> DataFrame:
    """Every run of words, anywhere in a text and over line ends, that matches a notice, a header or a licence body.

    Columns: doc_id, word_no (from 1), n_words, passage (lower case, without punctuation), license, template, dice. Runs
    start at a bigram of the template; their lengths go from threshold/(2 - threshold) to its inverse times the template's, one by
    one for templates of up to 31 bigrams, else by a sixteenth. Of runs that overlap the best is returned, then the
    first, then the longest. A text is compared with a template only if it shares as many bigrams as a match must.
    """
    shapes = _shapes(docs.sparkSession, threshold, notices)
    every = shapes.select("listed", "signs").collect()
    listed, signs = (F.array(*[F.lit(x) for x in sorted({x for r in every for x in r[c]})]) for c in ("listed", "signs"))
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words")).where(F.arrays_overlap("words", signs))
    texts = texts.withColumn("pairs", F.array_compact(neighbours(F.col("words")))).where(F.arrays_overlap("pairs", listed))
    both = texts.join(F.broadcast(shapes), F.arrays_overlap("pairs", "listed") & (F.size(F.array_intersect("pairs", "known")) >= F.col("least")))

    def measured(at: Column, size: Column) -> Column:
        own = F.array(F.array_distinct(F.slice("pairs", at, size)))
        dice = lambda s: F.round(F.lit(2.0) * F.size(F.array_intersect(s, F.col("known"))) / (F.size(s) + F.col("n")), 6)
        return F.transform(own, lambda s: F.struct(dice(s).alias("dice"), (-at).alias("before"), F.least(size, F.size("pairs") + 1 - at).alias("size")))[0]

    starts = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: F.array_contains("known", F.element_at("pairs", i)))
    runs = F.transform(starts, lambda i: F.array_max(F.transform("sizes", lambda k: measured(i, k))))
    good = F.sort_array(F.filter(runs, lambda r: r.dice >= threshold), asc=False)
    apart = lambda x, y: (-x.before > y.size - y.before) | (-y.before > x.size - x.before)
    add = lambda got, x: F.when(F.forall(got, lambda y: apart(x, y)), F.concat(got, F.array(x))).otherwise(got)
    # bound to a name of its own, or the runs would be made for each mention
    best = F.flatten(F.transform(F.array(good), lambda x: F.aggregate(x, F.filter(x, lambda r: F.lit(False)), add)))
    rows = both.select("doc_id", "words", "license", "template", F.explode(best).alias("run"))
    at, size = -F.col("run.before"), F.col("run.size") + 1
    passage = F.array_join(F.slice("words", at, size), " ")
    return rows.select("doc_id", at.alias("word_no"), size.alias("n_words"), passage.alias("passage"), "license", "template", "run.dice")


def sql(threshold: float = THRESHOLD, notices: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(notices))
    clean = lambda c: rf"trim(regexp_replace(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t0 AS (SELECT * FROM (VALUES {values}) v(template, license, notice)),
t1 AS (SELECT *, string_split({clean('notice')}, ' ') AS w FROM t0), t2 AS (SELECT template, license, {pairs} AS own FROM t1),
t AS (SELECT template, license, len(own) AS template_size, unnest(own) AS bigram FROM t2),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
u1 AS (SELECT doc_id, line_no, line, string_split({clean('line')}, ' ') AS w FROM l),
u2 AS (SELECT doc_id, line_no, line, {pairs} AS own FROM u1 WHERE len(w) >= 2),
u AS (SELECT row_number() OVER () AS unit, * FROM u2),
x AS (SELECT unit, doc_id, line_no, line, len(own) AS own_size, unnest(own) AS bigram FROM u),
g AS (SELECT unit, doc_id, line_no, line, license, template, own_size, template_size, count(*) AS n FROM x JOIN t USING (bigram) GROUP BY ALL)
SELECT doc_id, line_no::INT AS line_no, line, license, template::INT AS template, round(2.0::DOUBLE * n / (own_size + template_size), 6) AS dice FROM g WHERE round(2.0::DOUBLE * n / (own_size + template_size), 6) >= {threshold}"""
