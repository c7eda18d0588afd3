"""SimHash near-dedup with multi-index hashing (Norouzi, Punjani and Fleet, 2012).

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in 3 bits or fewer
differ in at most one bit of some segment, so each is stored under its two segment values and looked up
under every value of the Hamming ball of radius 1 around them; matches are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, row_key, staged
from lodestone.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text in UTF-8: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space 09-0D and 20
    if not words:
        return 0
    line, size = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:size].tolist(), ends[min(shingle, len(words)) - 1 :][:size].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], seed) for i, j in zip(first, last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, size, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns and fp (the 64 bits as a signed long), one row per document; null text counts as empty."""
    carried = ["doc_id", *more]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            made = np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(made, pa.int64())], [*carried, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*carried, F.col("text").cast("string").alias("text")).mapInArrow(each, "".join(f"{c} {kinds[c]}, " for c in carried) + "fp long")


def _ball() -> list:
    """(segment, value, home) and fp: the segment's own value, and those that differ from it in one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])

    def around(segment: int, value: Column) -> Column:
        return F.transform(flips, lambda x: F.struct(F.lit(segment).alias("segment"), value.bitwiseXOR(x).alias("value"), (x == 0).alias("home")))

    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return [F.explode(F.concat(around(0, low), around(1, high))).alias("key"), F.col("fp")]


def _linked(home: np.ndarray, other: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a bucket that is connected by verified distances: at most one per fingerprint."""
    nodes = np.concatenate([home, other])
    left, a, b = np.ones(len(nodes), bool), [], []
    for start in range(len(home)):
        if not left[start]:
            continue
        left[start] = False
        queue = [nodes[start]]
        while queue:
            x = queue.pop()
            open_ = np.flatnonzero(left)
            near = open_[np.bitwise_count(nodes[open_] ^ x) <= distance]
            if len(near):
                left[near] = False
                a.append(np.full(len(near), x))
                b.append(nodes[near])
                queue.extend(nodes[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within the distance.

    Each bucket's rows come sorted, and a bucket answers with a spanning forest, not with its pairs.
    """
    if distance > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            sizes = np.diff(np.append(starts, len(fp)))
            full = (np.add.reduceat(home.astype(np.int64), starts) > 0) & (sizes > 1)
            a, b = [], []
            for s, n in zip(starts[full].tolist(), sizes[full].tolist()):
                own, here = fp[s : s + n], home[s : s + n]
                x, y = _linked(own[here], own[~here], distance)
                a.append(x)
                b.append(y)
            both = [np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in both], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "value", "fp", "home")]
            rows = np.stack([cols[0].astype(np.int64), cols[1], cols[2], cols[3].astype(np.int64)], 1)
            if not len(rows):
                continue
            # only the last bucket of what came so far can go on in the next batch
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            if not len(cut) and held and (held[-1][-1, :2] == rows[0, :2]).all():
                held.append(rows)
                continue
            at = int(cut[-1]) + 1 if len(cut) else 0
            done = np.concatenate([*held, rows[:at]])
            held = [rows[at:]]
            if len(done):
                yield solve(done[:, :2], done[:, 2].view(np.uint64), done[:, 3].astype(bool))
        if held:
            done = np.concatenate(held)
            yield solve(done[:, :2], done[:, 2].copy().view(np.uint64), done[:, 3].astype(bool))

    probes = fps.select(*_ball()).select("key.segment", "key.value", "key.home", "fp")
    probes = probes.repartition("segment", "value").sortWithinPartitions("segment", "value")
    return probes.mapInArrow(buckets, "a long, b long")


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """The distinct fingerprints with the root of their component."""
    found = staged(components(links(nodes.select("fp"), distance)), "components")
    return nodes.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Each row's fingerprint and component: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in `distance` bits or fewer. Null
    and empty texts have fingerprint 0 and are linked like others. Equal fingerprints are one node; repeated
    rows and null ids share their fingerprint's component (null if it has no other id). Other columns are not read.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    ranked = _rooted(nodes, distance)
    least = ranked.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = staged(ranked.join(least, "root").select("fp", "n", "component_id"), "groups")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return attach(rows, groups, ["fp"], "n").select("doc_id", hex_, "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of docs: the one of smallest doc_id, one without an id only if none has one.

    Rows of one id or of none are told apart by the SHA-256 of their text, so each component keeps a row of its own.
    Null text counts as empty; an empty table gives an empty one.
    """
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first")
    nodes = staged(fingerprints(keyed, "_key").groupBy("fp").agg(first), "nodes")
    stay = _rooted(nodes, DISTANCE).groupBy("root").agg(F.min("first").alias("first")).select("first._key")
    # the join has dealt and sorted the rows by the key already: no further exchange
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
