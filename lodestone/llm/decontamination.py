"""Benchmark decontamination with Wu-Manber multi-pattern search (Wu and Manber, 1994) over words.

A test string is a window of consecutive words of a benchmark item. For each length of test strings a shift table says, by
the block of the last words at a position, how far the next possible end lies; blocks that end a test string lead to a bucket,
its strings are picked by their first words and confirmed word by word. The benchmark is split into parts of bounded size, and
each part passes over all documents, so neither driver nor task holds more of it than one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import staged

#: Words of a window; words of the block that the shift table looks at.
WINDOW, BLOCK = 10, 2
#: Bytes of benchmark text in a part, and words of the pieces into which long items are cut.
PART, PIECE = 4 << 20, 1 << 14
# Words are runs of a-z, 0-9 and of what is not ASCII; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none."""
    return (text or b"").translate(_FOLD).split()


class ShiftTable:
    """Test strings of one length, given as places in a list of word numbers."""

    def __init__(self, size: int, flat: list[int], starts: list[int]) -> None:
        self.size, self.flat = size, flat
        self.block = min(BLOCK, size)
        self.far = size - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = {}
        for s in starts:
            for end in range(self.block, size + 1):
                key, to_end = tuple(flat[s + end - self.block : s + end]), size - end
                if to_end < self.shift.get(key, self.far):
                    self.shift[key] = to_end
            last, first = tuple(flat[s + size - self.block : s + size]), tuple(flat[s : s + self.block])
            self.buckets.setdefault(last, {}).setdefault(first, []).append(s)

    def find(self, text: list[int | None]) -> Iterator[tuple[int, int]]:
        """Place in the text and test string of each occurrence; a word number of None is in no test string."""
        size, block, far, shift, flat, n = self.size, self.block, self.far, self.shift, self.flat, len(text)
        at = size  # where a test string may end
        while at <= n:
            if text[at - 1] is None:
                at += size
                continue
            key = tuple(text[at - block : at])
            step = shift.get(key, far)
            if not step:
                begin = at - size
                here = text[begin:at]
                for s in self.buckets[key].get(tuple(here[:block]), ()):
                    if flat[s : s + size] == here:
                        yield begin, s
                step = 1
            at += step


class TestStrings:
    """A part of the benchmark: word numbers, a shift table for each length, and the items that hold each test string."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str | None, bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self.owners: dict[int, list[int]] = {}
        flat: list[int] = []
        seen: dict[tuple, int] = {}
        starts: dict[int, list[int]] = {}
        for item, text in pieces:
            ids = [self.number.setdefault(w, len(self.number)) for w in text.split()]
            base = len(flat)
            flat += ids
            self.items.append(item)
            size = min(WINDOW, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                s = seen.setdefault(tuple(ids[i : i + size]), base + i)
                if s == base + i:
                    starts.setdefault(size, []).append(s)
                own = self.owners.setdefault(s, [])
                if not own or own[-1] != len(self.items) - 1:
                    own.append(len(self.items) - 1)
        self.tables = [ShiftTable(size, flat, at) for size, at in sorted(starts.items())]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Covered ranges of words, disjoint and in order, and the items (null for those without an id)."""
        numbers = list(map(self.number.get, text))
        found = sorted((at, at + table.size, s) for table in self.tables for at, s in table.find(numbers))
        items = {self.items[i] for s in {s for _, _, s in found} for i in self.owners[s]}
        return merged([(a, b) for a, b, _ in found]), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges as disjoint ones; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame) -> DataFrame:
    """item, text (words joined by a space), size: items in pieces of bounded length that share WINDOW - 1 words with the next."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                have = words(text.as_py())
                for at in range(0, max(1, len(have) - WINDOW + 1), PIECE):
                    items.append(item)
                    texts.append(b" ".join(have[at : at + PIECE + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["item", "text"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "item string, text string").where("text <> ''").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """Where benchmark windows stand in documents: doc_id, n_words, spans (array of start and end, in words), items (sorted ids as strings).

    A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. One row per row of docs,
    repeated ones too; null texts have no words. An item without an id marks words but is not named; repeated items are named
    once. With an empty benchmark nothing is found; an empty docs gives an empty table. Other columns are not read. Texts of any
    length are searched whole; a task holds one batch of texts and one part of the benchmark.
    """
    spark, doc_id = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    pieces = staged(_pieces(benchmark), "test-strings")
    parts = max(1, -(-(pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part))
    spans = "array<struct<start: int, end: int>>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).alias("n_words"), F.lit(None).cast(spans).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(parts):
        # bounded by its part: pieces are dealt by a hash
        held = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()
        tables = spark.sparkContext.broadcast(TestStrings([(r.item, r.text.encode()) for r in held]))

        def each(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, ranges, items = [], [], []
                for text, old, named in zip(batch["text"].cast(pa.binary()), batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
                    have = words(text.as_py())
                    own, found = tables.value.search(have)
                    if old:
                        own = merged(sorted([*own, *[(r["start"], r["end"]) for r in old]]))
                    sizes.append(len(have))
                    ranges.append([{"start": a, "end": b} for a, b in own])
                    items.append(sorted({*found, *(named or ())} - {None}, key=str.encode))
                kinds = (pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
                made = [pa.array(v, k) for v, k in zip((sizes, ranges, items), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], *made], ["doc_id", "text", "n_words", "spans", "items"])

        rows = rows.mapInArrow(each, f"doc_id {doc_id}, text string, n_words int, spans {spans}, items array<string>")
        if k < parts - 1:
            rows = staged(rows, "searched")
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of occurrences(): n_hit words in spans, n_items, items_sha256 of the ids joined by commas, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
t AS (SELECT DISTINCT item_id, m, ws[i:i + m - 1] AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
v AS (SELECT d.row, z.m, d.ws[i:i + z.m - 1] AS win, i FROM (SELECT row, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM t) z WHERE len(ws) >= m) z JOIN d USING (row)),
h AS (SELECT v.row, v.i, v.m, t.item_id FROM v JOIN t ON v.m = t.m AND v.win = t.win),
n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS p FROM h) GROUP BY row),
k AS (SELECT row, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h WHERE item_id IS NOT NULL GROUP BY row)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(len(k.ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(k.ids, ','), '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN k USING (row)"""
