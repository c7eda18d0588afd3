"""Chunkers: sections to offset-exact chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.parsing import BLOCKS, HEADS, LINES, slices, spread, with_blocks
from lodestone.registry import query, table

TARGET, OVERLAP, CHILD = 350, 60, 120


def check_sizes(target: int, overlap: int) -> None:
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("a chunker needs target > 0 and 0 <= overlap < target")


def bodies(docs: DataFrame, *more: str) -> DataFrame:
    """The blocks of docs with their text: doc_id, more columns, block, start, end, title, body, chunk_id, word_count; cut where the text lies."""
    rows = with_blocks(spread(docs.select("doc_id", "text", *more)))
    cut = lambda b: F.substring(F.col("text"), b["start"].cast("int") + 1, (b["end"] - b["start"]).cast("int"))
    rows = rows.select("doc_id", *more, F.inline(F.transform("blocks", lambda b: b.withField("body", cut(b)))))
    chunk_id = F.concat_ws("", F.col("doc_id"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return rows.withColumn("chunk_id", chunk_id).withColumn("word_count", F.size(T.words(F.col("body"))))


def blocks(text: str) -> list[tuple[int, int, int, bool]]:
    """What a window may not cut, as (start, end, words, whether a table): whole tables, also unclosed ones, and lines that are not blank."""
    found, at, table = [], 0, False
    for line in text.split("\n"):
        end, mark, words = at + len(line), line.strip(), len(line.split())
        if table:
            begin, _, held, _ = found.pop()
            found.append((begin, end, held + words, True))
            table = mark != "[/TABLE]"
        elif mark:
            table = mark == "[TABLE]"
            found.append((at, end, words, table))
        at = end + 1
    return found


def windows(text: str, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Blocks in windows of at most `target` words, one block at least; each but the first begins with the last lines, back to a table, that hold at most `overlap`."""
    found = blocks(text)
    first = held = 0
    for i, (_, _, words, _) in enumerate(found):
        if i > first and held + words > target:
            yield found[first][0], found[i - 1][1]
            back, held = i, 0
            while back > first and not found[back - 1][3] and held + found[back - 1][2] <= overlap:
                back -= 1
                held += found[back][2]
            first = back
        held += words
    if found:
        yield found[first][0], found[-1][1]


def _spans(of: Callable[[pa.RecordBatch], Iterator[tuple]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives doc_id and what `of` finds in a slice, as (row of the slice, a number for each name)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(of(batch))
            at, *numbers = [pa.array([r[k] for r in found], pa.int64()) for k in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), *numbers], ["doc_id", *names])

    return each


def packed(rows: DataFrame, target: int, overlap: int) -> DataFrame:
    """The windows of each row's body, from its start on: (doc_id, start, end, parent_start, parent_end), linear in the length of a text."""
    check_sizes(target, overlap)

    def spans(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, (s, e, t) in enumerate(zip(*(batch[c].to_pylist() for c in ("start", "end", "body")), strict=True)):
            for a, b in windows(t or "", target, overlap):
                yield i, s + a, s + b, s, e

    names = ["start", "end", "parent_start", "parent_end"]
    return rows.select("doc_id", "start", "end", "body").mapInArrow(_spans(spans, names), f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names))


def fixed(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    rows = spread(docs.select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("body")))
    return packed(rows, target, overlap).select("doc_id", "start", "end")


def section_aware(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """One chunk per section; sections above the target are packed by lines and tables."""
    found = bodies(docs).where("word_count > 0")
    short = found.where(F.col("word_count") <= target).select("doc_id", "start", "end")
    return short.unionByName(packed(found.where(F.col("word_count") > target), target, overlap).select("doc_id", "start", "end"))


def parent_child(docs: DataFrame, child: int = CHILD) -> DataFrame:
    """Small children packed inside each section, with the section as their parent."""
    return packed(bodies(docs).where("word_count > 0"), child, 0)


def effective(chunks: DataFrame) -> DataFrame:
    """Adds the span by which a chunk is judged: its parent's, where it has one, else its own."""
    whole = F.col("parent_start").isNotNull() & F.col("parent_end").isNotNull()
    span = lambda name: F.when(whole, F.col(f"parent_{name}")).otherwise(F.col(name))
    return chunks.withColumn("span_start", span("start")).withColumn("span_end", span("end"))


# Separators, coarse to fine.
MARKS = ("\n", ". ", " ")


def piece_edges(text: str, target: int, marks: tuple[str, ...] = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of pieces of at most `target` words, and the words before each edge.

    The ends of a mark become edges only inside pieces that coarser marks leave too long. A piece without any mark stays whole.
    """
    starts = np.array([m.start() for m in re.finditer(r"\S+", text)], np.int64)
    edges = np.array([0, len(text)], np.int64)
    for level, mark in enumerate(marks):
        words = np.searchsorted(starts, edges)
        ends = np.array([m.end() for m in re.finditer(re.escape(mark), text)], np.int64)
        holder = np.searchsorted(edges, ends, side="left") - 1
        edges = np.union1d(edges, ends[np.diff(words)[holder] > target] if len(ends) else ends)
    return edges, np.searchsorted(starts, edges)


def recursive_spans(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of neighbouring pieces up to the target; each but the first begins with the pieces that hold the last `overlap` words."""
    edges, words = piece_edges(text, target)
    out, first, least = [], 0, 1
    while least < len(edges):
        last = max(least, int(np.searchsorted(words, words[first] + target, side="right")) - 1)
        if words[last] > words[first]:
            out.append((int(edges[first]), int(edges[last])))
        first = max(first, int(np.searchsorted(words, words[last] - overlap)))
        least = last + 1
    return out


def recursive(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    check_sizes(target, overlap)

    def spans(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, t in enumerate(batch["text"].to_pylist()):
            for a, b in recursive_spans(t or "", target, overlap):
                yield i, a, b

    return spread(docs.select("doc_id", "text")).mapInArrow(_spans(spans, ["start", "end"]), f"doc_id {dict(docs.dtypes)['doc_id']}, start long, end long")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "recursive": recursive, "section-aware": section_aware, "parent-child": parent_child}


def chunk(docs: DataFrame, strategy: str, **sizes: int) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known: {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[strategy](docs, **sizes)


def size_stats(chunks: DataFrame, target: int = TARGET, small: int = 50) -> DataFrame:
    """Per source: chunks, least and most words, oversized, small, and the words at index floor(n / 2) and floor(0.9 n).

    Chunks are counted by size first, so a source of any size is a few thousand rows for the running sums.
    """
    sizes = chunks.groupBy("source", "word_count").agg(F.count(F.lit(1)).alias("c"))
    per = Window.partitionBy("source")
    sizes = sizes.withColumn("upto", F.sum("c").over(per.orderBy("word_count"))).withColumn("n", F.sum("c").over(per))
    # the value at an index is the least whose running count is beyond it
    at = lambda f: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(f)), F.col("n") - 1), F.col("word_count")))
    among = lambda which: F.sum(F.when(which, F.col("c")).otherwise(0))
    return sizes.groupBy("source").agg(
        F.sum("c").alias("n"), F.min("word_count").alias("least"), F.max("word_count").alias("most"),
        among(F.col("word_count") > target).alias("oversized"), among(F.col("word_count") < small).alias("small"),
        at(0.5).alias("median"), at(0.9).alias("p90"),
    )


WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))::INT"
BODY = f"""c AS (SELECT b.doc_id, b.start, b."end", substring(d.text, b.start + 1, b."end" - b.start) AS body, b.doc_id || ':' || b.start || '-' || b."end" AS chunk_id, d.source FROM b JOIN documents d USING (doc_id)),
w AS (SELECT *, {WORDS.format("body")} AS word_count FROM c)"""


@query(f'WITH {LINES}, {HEADS}, {BLOCKS}, {BODY} SELECT doc_id, start, "end", chunk_id, word_count, md5(body) AS digest FROM w')
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = bodies(docs)
    return rows.select("doc_id", "start", "end", "chunk_id", "word_count", F.md5("body").alias("digest"))


@query(f'WITH {LINES}, {HEADS}, {BLOCKS}, {BODY} SELECT doc_id, start, "end" FROM w WHERE word_count BETWEEN 1 AND 1000000')
def section_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_aware(table(spark, sf_dir, "documents"), target=1_000_000)


@query()
def section_aware_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_aware(table(spark, sf_dir, "documents"))


@query()
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(table(spark, sf_dir, "documents"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive(table(spark, sf_dir, "documents"))


@query()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parent_child(table(spark, sf_dir, "documents"))


@query(
    f"WITH {LINES}, {HEADS}, {BLOCKS}, {BODY}, s AS (SELECT source, count(*) AS n, min(word_count) AS least, max(word_count) AS most, count(*) FILTER (word_count > 350) AS oversized, "
    "count(*) FILTER (word_count < 50) AS small, list_sort(list(word_count)) AS ws FROM w GROUP BY source) "
    "SELECT source, n, least, most, oversized, small, ws[least(floor(n * 0.5::DOUBLE), n - 1)::INT + 1] AS median, ws[least(floor(n * 0.9::DOUBLE), n - 1)::INT + 1] AS p90 FROM s"
)
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_stats(bodies(table(spark, sf_dir, "documents"), "source"))


@query(
    f"WITH {LINES}, {HEADS}, {BLOCKS} SELECT b.doc_id, b.block, 'search_document: ' || d.source || ' (' || d.lang || ')' || ' | ' || coalesce(b.title, '') AS header FROM b JOIN documents d USING (doc_id)"
)
def context_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance header that goes before a chunk's text, with the prefix of the document side."""
    rows = bodies(table(spark, sf_dir, "documents"), "source", "lang")
    header = F.concat(F.lit("search_document: "), "source", F.lit(" ("), "lang", F.lit(")"), F.lit(" | "), F.coalesce("title", F.lit("")))
    return rows.select("doc_id", "block", header.alias("header"))
