"""Exact dedup of incoming documents against immutable snapshots.

A snapshot is written once: one record per distinct digest and, per digest bucket, a static 3-wise binary
fuse filter (Graf and Lemire, 2022) of one byte a slot. An incoming batch is first grouped by digest on its
own; its distinct digests are screened by the filters, and only the positives join the snapshot's exact
buckets, where the normalised bytes are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.common import attach, fold, row_key, staged

#: Distinct digests for each bucket and filter; a task holds one bucket of each side at a time.
BUCKET_KEYS = 200_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of shifts and multiplications."""
    x = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length and number of slots for n keys."""
    if n < 2:
        return 4, 12
    length = min(1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    segments = max(1, math.ceil(n * factor / length) - 2)
    return length, (segments + 2) * length


def _slots(keys: np.ndarray, seed: int, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments, and the fingerprint byte, of each key."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(size - 2 * length) >> np.uint64(32)).astype(np.int64)
    mask = length - 1
    second = (first + length) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
    third = (first + 2 * length) ^ (h.astype(np.int64) & mask)
    return np.stack([first, second, third]), (_mix(h, 0x9E3779B97F4A7C15) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A binary fuse filter of distinct unsigned 64-bit keys: a header of seed, length and size, then the slots."""
    length, size = _shape(len(keys))
    with np.errstate(over="ignore"):
        for seed in range(1, 1000):
            slots, marks = _slots(keys, seed, length, size)
            order = _peel(slots, size)
            if order is not None:
                table = np.zeros(size, np.uint8)
                for who, own in reversed(order):
                    table[own] = 0
                    table[own] = marks[who] ^ table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
                return np.array([seed, length, size], np.int64).tobytes() + table.tobytes()
    raise ValueError("keys of a binary fuse filter must be distinct")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each alone holds); None if some keys never come alone."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    total = np.zeros(size, np.int64)
    for row in slots:
        np.add.at(total, row, np.arange(n))
    order, left, alone = [], n, np.flatnonzero(count == 1)
    while len(alone):
        who, at = np.unique(total[alone], return_index=True)
        order.append((who, alone[at]))
        left -= len(who)
        touched = slots[:, who].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(who, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return order if left == 0 else None


def may_contain(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter was not built from; true for about 1 in 256 of those too."""
    seed, length, size = np.frombuffer(blob[:24], np.int64)
    table = np.frombuffer(blob, np.uint8, offset=24)
    with np.errstate(over="ignore"):
        slots, marks = _slots(keys, int(seed), int(length), int(size))
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == marks


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased (null: empty), one row per document."""
    return docs.select("doc_id", F.sha2(fold(F.col("text")), 256).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One record per digest: the largest doc_id and the number of rows. Counts combine before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("n"))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of the snapshot's distinct digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(rows["word"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "filter": [build_filter(keys)]})

    keyed = snapshot.select(*_keyed(buckets))
    return keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def _keyed(buckets: int) -> list:
    word = F.xxhash64("digest")
    return [F.pmod(F.xxhash64(F.lit("bucket"), F.col("digest")), F.lit(buckets)).alias("bucket"), word.alias("word")]


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming distinct digests that the snapshot's filters don't rule out."""

    def probe(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if not len(made):
            return rows[["digest", "top_id", "n"]][:0]
        hit = may_contain(made["filter"].iloc[0], rows["word"].to_numpy().astype(np.uint64))
        return rows.loc[hit, ["digest", "top_id", "n"]]

    keyed = incoming.select("digest", "top_id", "n", *_keyed(buckets))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, incoming.schema)


def _texts(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The normalised text of one row for each (digest, top_id)."""
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("top_id")), "inner")
    found = found.select("digest", fold(F.col("text")).alias(name))
    return found.where(F.sha2(name, 256) == F.col("digest")).dropDuplicates(["digest"])


def match_snapshot(docs: DataFrame, positives: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Positives with the same bytes in the snapshot: digest, both top ids and both counts."""
    exact = positives.join(snapshot.withColumnsRenamed({"top_id": "old_id", "n": "old_n"}), "digest")
    exact = staged(exact, "exact")
    new = _texts(docs, exact.select("digest", "top_id"), "new_text")
    old = _texts(docs, exact.select("digest", F.col("old_id").alias("top_id")), "old_text")
    equal = new.join(old, "digest").where(F.col("new_text") == F.col("old_text")).select("digest")
    return exact.join(equal, "digest", "left_semi")


def _older(docs: DataFrame) -> Column:
    """Whether a row belongs to the snapshot; null for a row without an id."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= (0 if low is None else (low + high) // 2)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each row's group of equal texts, lower-casing A-Z only; of each group the largest doc_id stays.

    The older half of the doc_id range is the snapshot, the rest (and rows without a doc_id) the incoming
    batch; of ids that are no numbers, half by their hash. Columns: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. Rows that
    repeat a doc_id and text are counted in group_size and carry the same result; a null doc_id stays only
    in a group without any other id. An empty table gives no rows; other columns are not read.
    """
    rows = digests(docs).withColumn("old", F.coalesce(_older(docs), F.lit(False)))
    rows = staged(rows, "digests")
    snapshot = staged(distinct_digests(rows.where("old")), "snapshot")
    incoming = staged(distinct_digests(rows.where("NOT old")), "incoming")
    buckets = max(1, math.ceil(max(snapshot.count(), incoming.count()) / BUCKET_KEYS))
    filters = staged(snapshot_filters(snapshot, buckets), "filters")
    positives = screen(incoming, filters, buckets)
    both = staged(match_snapshot(docs, positives, snapshot), "both")
    merged = both.select(
        "digest", F.greatest("top_id", "old_id").alias("merged_id"), (F.col("n") + F.col("old_n")).alias("merged_n")
    )

    def side(groups: DataFrame, old: bool) -> DataFrame:
        keep, size = F.coalesce("merged_id", "top_id").alias("keep_id"), F.coalesce("merged_n", "n").alias("group_size")
        return groups.join(merged, "digest", "left").select("digest", F.lit(old).alias("old"), "n", keep, size)

    groups = staged(side(snapshot, True).unionByName(side(incoming, False)), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    found = attach(rows, groups, ["digest", "old"], "n")
    return found.select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each group of equal texts, with the columns of docs.

    Null text counts as empty. A row without an id stays only if its group has no id; of rows that repeat id and
    text, one stays. An empty table gives an empty one; other columns play no part.
    """
    stay = exact_groups(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.sha2(fold(F.col("text")), 256)))
    # the join has dealt and sorted the rows by the key already: no further exchange
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
