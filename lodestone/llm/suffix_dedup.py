"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers.

Windows of the length are dealt to groups by content. A window's anchor is its k-gram of least hash (winnowing,
Schleimer, Wilkerson and Aiken, 2003), so equal windows have equal anchors at equal distances from their start.
Neighbouring windows with one anchor travel as one span of text; a span whose anchor occurs once is unique.
Spans are then halved by the distance of the anchor: all windows of a half hold a longer stretch around the anchor,
which becomes the group's new key, and pieces that are alone under it are unique. Groups that are still too
large for a task are halved again, at most until a piece is one window and its key is all of it.

In a group, shards of pieces get their own suffix order; their Burrows-Wheeler transforms are merged by refining
the interleave of the shards (Holt and McMillan, 2014), which gives the common prefixes of neighbours and from
them the repeated intervals. A shard's suffixes stay in their order throughout: a merge only finds from which shard
each suffix comes. As `length` single-byte rounds would be too many, a round's symbol is as long as the depth reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, staged

LENGTH, GRAM = 400, 32
#: Bytes hashed at once, bytes of a shard, shards merged at once, and pieces of a key beyond which they are halved again.
PIECE, SHARD, SHARDS, CROWD = 1 << 19, 1 << 18, 4, 512
#: Texts held as Python objects at once.
ROWS = 1024
# An odd multiplier of the polynomial hash, and one that spreads its bits.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    made = _powers.get(base)
    if made is None or len(made[0]) < n:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            pair.append(np.cumprod(row))
        _powers[base] = made = (pair[0], pair[1])
    return made


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(SPREAD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(SPREAD)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each place, equal wherever the bytes are equal."""
    up, down = _power(BASE, max(PIECE + 4096, len(data) + 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return _spread((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def _digest(data: bytes | memoryview, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima of blocks to both sides."""
    n, pad = len(key) - width + 1, -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchored_spans(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first window, number of windows, place of the anchor from the first, anchor and digest of each run of windows with one anchor."""
    begin, end = offsets[:-1], offsets[1:]
    for low in range(0, len(data), PIECE):
        x = data[low : low + PIECE + length - 1]
        if len(x) < length:
            return
        grams = gram_hashes(x, gram)
        places = np.uint64((1 << 22) - 1)
        least = _sliding_min((grams & ~places) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        at = (least & places).astype(np.int64)
        first = np.arange(len(at)) + low
        text = np.searchsorted(end, first, side="right")
        inside = first + length <= end[np.minimum(text, len(end) - 1)]
        inside &= np.arange(len(at)) < PIECE
        good = np.flatnonzero(inside)
        if not len(good):
            continue
        new = np.concatenate([[True], (np.diff(good) != 1) | (np.diff(at[good]) != 0) | (np.diff(text[good]) != 0)])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(good)))
        s = good[start]
        view = memoryview(x)
        digests = b"".join([_digest(view[a:b]) for a, b in zip(s.tolist(), (s + count + length - 1).tolist())])
        yield text[s], s + low - begin[text[s]], count, at[s] - s, grams[at[s]].view(np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts end to end, and the edges of its texts (null: empty)."""
    parts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: their texts are held twice at times."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per run of windows with one anchor: doc_id, mark (of the text), first, count, at (the anchor's place from the first), key, h1, h2."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "first", "count", "at", "key", "h1", "h2"]
        for batch in _slices(batches):
            data, offsets = _buffers(batch.column("text"))
            for text, first, count, at, key, digest in anchored_spans(data, offsets, length, gram):
                rows = pa.array(text)
                own = [batch.column("doc_id").take(rows), batch.column("mark").take(rows)]
                rest = [pa.array(v.astype(np.int32)) for v in (first, count, at)] + [pa.array(np.ascontiguousarray(v)) for v in (key, digest[:, 0], digest[:, 1])]
                yield pa.RecordBatch.from_arrays(own + rest, names)

    kind = dict(docs.dtypes)["doc_id"]
    return marked(docs).mapInArrow(each, f"doc_id {kind}, mark long, first int, count int, at int, key long, h1 long, h2 long")


def marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("text").cast("string").alias("text"))


def _pack(x: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a number that sorts like them."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(x), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(x)]
    return key


def _depths(length: int) -> list[tuple[int, int]]:
    """The bytes of a symbol and the depth reached by each round, from the 8 bytes that a number holds."""
    rounds, depth = [], 8
    while depth < length:
        step = min(depth, length - depth)
        rounds.append((step, depth + step))
        depth += step
    return rounds


def _arranged(key: np.ndarray) -> np.ndarray:
    """The stable order of keys, found by sorting them with their places in the lower bits."""
    bits = max(1, len(key) - 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    packed = np.sort((key << np.int64(bits)) | np.arange(len(key)))
    return packed & np.int64((1 << bits) - 1)


def _blocks(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the slot in which its block begins, and whether the block has several slots."""
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    return np.repeat(start, size), np.repeat(size > 1, size)


def suffix_order(x: np.ndarray, length: int) -> np.ndarray:
    """The order of a shard's suffixes by their first `length` bytes."""
    key = _pack(x)
    order = np.argsort(key)
    sorted_ = key[order]
    first, several = _blocks(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.empty(len(x), np.int64)
    rank[order] = first
    for step, reach in _depths(length):
        slots = np.flatnonzero(several)
        if not len(slots):
            break
        act = order[slots]
        far = act + (reach - step)
        after = np.where(far < len(x), rank[np.minimum(far, len(x) - 1)] + 1, 0)
        if len(x) < 1 << 21:
            at = _arranged(rank[act] * np.int64(len(x) + 1) + after)
        else:
            at = np.lexsort((after, rank[act]))
        act, after = act[at], after[at]
        own = rank[act]
        order[slots] = act
        begins, more = _blocks(np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])]))
        rank[act] = slots[begins]
        several[slots] = more
    return order


def merge_transforms(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shards laid end to end: the merged order of suffixes, the merged transform, and common prefixes.

    The interleave says from which shard the suffix in each slot comes; a shard's own suffixes follow in the shard's order. A
    round walks the slots in order and hands each suffix's predecessor, `step` bytes before it, the next slot
    of its block: that sorts the blocks by `step` bytes more. A common prefix is that of the suffixes in a slot and in
    the one before it, as far as rounds tell them apart: at least so many bytes, at most `length`.
    """
    x = np.concatenate(shards)
    edges = np.cumsum([0, *[len(s) for s in shards]])
    own = [suffix_order(s, length) + at for s, at in zip(shards, edges)]
    key = np.concatenate([_pack(s) for s in shards])
    base = np.concatenate(own)
    sizes = [len(s) for s in shards]
    start, end = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
    if len(shards) == 1:
        order, interleave = base, np.zeros(len(x), np.uint8)
    else:
        at = np.argsort(key[base], kind="stable")
        order, interleave = base[at], np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)[at]
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    common = np.where(new, 0, length).astype(np.int32)
    first, several = _blocks(new)
    block = np.empty(len(x), np.int64)
    block[order] = first
    live = np.empty(len(x), bool)
    live[order] = several
    for step, reach in _depths(length):
        before = order - step
        before = before[before >= start[order]]
        before = before[live[before]]
        # suffixes of a live block that end within `step` bytes come first
        short = np.concatenate([np.arange(max(b - step, a), b) for a, b in zip(edges[:-1], edges[1:])])
        before = np.concatenate([short[live[short]], before])
        if not len(before):
            break
        placed = before[_arranged(block[before])]
        slots = np.flatnonzero(several)
        place = placed + step
        after = np.where(place < end[placed], block[np.minimum(place, len(x) - 1)], -1)
        inner = block[placed]
        split = np.concatenate([[True], (inner[1:] != inner[:-1]) | (after[1:] != after[:-1])])
        within = split & np.concatenate([[False], inner[1:] == inner[:-1]])
        common[slots[within]] = reach - step
        if len(shards) > 1:
            interleave[slots] = np.searchsorted(edges, placed, side="right") - 1
            for s, suffixes in enumerate(own):
                order[interleave == s] = suffixes
        else:
            order[slots] = placed
        begins, more = _blocks(split)
        block[order[slots]] = slots[begins]
        several[slots] = more
        live[order[slots]] = more
    return order, x[order - 1], common


def repeated_intervals(common: np.ndarray, length: int) -> np.ndarray:
    """Whether a slot lies in an interval of several suffixes that share `length` bytes."""
    same = common[1:] >= length
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def repeated_windows(texts: list[bytes], counts: list[int], twice: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Runs (start, end) of windows of each piece that occur elsewhere in the pieces; all of a piece that occurs twice.

    A window is a suffix's first `length` bytes, which lie in its piece; the other suffixes only carry the order on.
    """
    sizes, counts_ = np.array([len(t) for t in texts]), np.array(counts)
    shard = np.cumsum(sizes) // SHARD
    shards = [np.frombuffer(b"".join(texts[a:b]), np.uint8) for a, b in zip(*_edges(shard))]
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts_)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts_) - counts_, counts_)
    # the other suffixes leave the order, and neighbours share the least of the prefixes between them
    order, _, common = merge_transforms(shards, length)
    asked = np.zeros(len(order), bool)
    asked[begin[owner] + window] = True
    slots = np.flatnonzero(asked[order])
    least = np.minimum.reduceat(common[: slots[-1] + 1], np.concatenate([[0], slots[:-1] + 1]))
    hit = np.zeros(len(order), bool)
    hit[order[slots]] = repeated_intervals(least, length)
    return _runs(owner, window, hit[begin[owner] + window] | twice[owner], len(texts))


def _edges(group: np.ndarray) -> tuple[list[int], list[int]]:
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return start.tolist(), np.append(start[1:], len(group)).tolist()


def _runs(owner: np.ndarray, window: np.ndarray, again: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    hit = np.flatnonzero(again)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(hit):
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
        first = hit[np.flatnonzero(new)]
        last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        for o, a, b in zip(owner[first].tolist(), window[first].tolist(), window[last].tolist()):
            out[o].append((a, b + 1))
    return out


RUNS = "array<struct<start int, end int>>"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _run_rows(runs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], _RUNS)


BODIES = "key long, h1 long, h2 long, n long, m long, count int, at int, low int, high int, body binary"


def _cut(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The text of wanted spans, as BODIES says; n is how often a span occurs, m the number of its rows, low and high bound the anchor's distance."""
    ask = F.struct("key", "h1", "h2", "n", "m", "count", "at", "first")
    listed = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list(ask).alias("cuts"))
    rows = marked(docs)
    rows = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("text", "cuts")
    names = ["key", "h1", "h2", "n", "m", "count", "at"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                cuts = batch.column("cuts").slice(row, 1).flatten()
                first, count = cuts.field("first").to_pylist(), cuts.field("count").to_pylist()
                body = pa.array([text[a : a + c + length - 1] for a, c in zip(first, count)], pa.binary())
                ends = [pa.array(np.full(len(cuts), v, np.int32)) for v in (0, length - gram)]
                yield pa.RecordBatch.from_arrays([*[cuts.field(c) for c in names], *ends, body], [*names, "low", "high", "body"])

    return rows.mapInArrow(each, BODIES)


def _halves(bodies: DataFrame, length: int) -> DataFrame:
    """Each body's windows in two pieces, by the distance of the anchor from a window's start; key is a digest of what all such windows hold.

    k0, k1, k2 and m0 are the body's own key, digest and rows; off is the piece's first window in the body.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, off, count, at, low, high, keys, body = [], [], [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("count", "at", "low", "high", "body")]
            for row, (n, a, lo, hi, text) in enumerate(zip(*columns)):
                middle = (lo + hi) // 2
                cut = min(max(a - middle, 0), n)  # windows from here on are no farther than the middle
                for skip, size, near, far in ((0, cut, middle + 1, hi), (cut, n - cut, lo, middle)):
                    if size:
                        place, own = a - skip, text[skip : skip + size + length - 1]
                        source.append(row)
                        for column, value in zip((off, count, at, low, high, body), (skip, size, place, near, far, own)):
                            column.append(value)
                        keys.append(_digest(b"%d %d " % (near, far) + own[place - near : place - far + length], 8))
            rows = pa.array(source, pa.int64())
            old = [batch.column(c).take(rows) for c in ("key", "h1", "h2", "m", "n")]
            digest = np.frombuffer(b"".join(map(_digest, body)), np.int64).reshape(-1, 2)
            made = [np.frombuffer(b"".join(keys), np.int64), digest[:, 0], digest[:, 1]]
            new = [pa.array(np.ascontiguousarray(v)) for v in made] + [pa.array(v, pa.int32()) for v in (off, count, at, low, high)]
            names = ["k0", "k1", "k2", "m0", "n", "key", "h1", "h2", "off", "count", "at", "low", "high", "body"]
            yield pa.RecordBatch.from_arrays([*old, *new, pa.array(body, pa.binary())], names)

    schema = "k0 long, k1 long, k2 long, m0 long, n long, key long, h1 long, h2 long, off int, count int, at int, low int, high int, body binary"
    return bodies.mapInArrow(each, schema).withColumn("piece", F.monotonically_increasing_id())


def _divided(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of distinct bodies that share keys: key, h1, h2, m, runs. Groups of more than CROWD pieces are halved again."""
    pieces = staged(_halves(bodies, length), "pieces")
    one = pieces.groupBy("key", "h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("piece").alias("piece"), F.max("count").alias("count"))
    one = staged(one, "distinct_pieces")
    keys = staged(one.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 1"), "piece_keys")
    live = staged(attach(one, keys, ["key"], "rows", small=True), "live_pieces")
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("count").alias("end"))).alias("runs")
    whole = live.where("rows = 1").select("key", "h1", "h2", "m", all_)
    ends = pieces.select("piece", "at", "low", "high", "body")
    close = live.where("rows > 1").join(ends, "piece").select("key", "h1", "h2", "n", "m", "count", "at", "low", "high", "body", "rows")
    found = whole.unionByName(_matched(close.where(F.col("rows") <= CROWD), length))
    if live.where(F.col("rows") > CROWD).limit(1).count():
        found = found.unionByName(_divided(close.where(F.col("rows") > CROWD).drop("rows"), length))
    found = staged(found.where(F.size("runs") > 0), "found_pieces")
    back = attach(pieces.select("k0", "k1", "k2", "m0", "off", "key", "h1", "h2"), found, ["key", "h1", "h2"], "m", small=True)
    moved = F.transform("runs", lambda r: F.struct((F.col("off") + r.start).alias("start"), (F.col("off") + r.end).alias("end")))
    runs = back.select("k0", "k1", "k2", "m0", moved.alias("runs")).groupBy("k0", "k1", "k2", "m0").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return runs.select(F.col("k0").alias("key"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("m0").alias("m"), "runs")


def _matched(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the pieces of small groups, by merged transforms; a group is whole in one task, groups are merged together up to a size."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        runs = repeated_windows(table["body"].to_pylist(), table["count"].to_pylist(), table["n"].to_numpy() > 1, length)
        cols = [table[c].combine_chunks() for c in ("key", "h1", "h2", "m")]
        return pa.RecordBatch.from_arrays([*cols, _run_rows(runs)], ["key", "h1", "h2", "m", "runs"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            key = batch.column("key").to_numpy()
            sizes = pa.compute.binary_length(batch.column("body")).to_numpy()
            for a, b in zip(*_edges(key)) if len(key) else ():
                if size >= SHARD * SHARDS and key[a] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                last = key[a]
        if held:
            yield solve(held)

    dealt = bodies.select("key", "h1", "h2", "n", "m", "count", "body").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(each, f"key long, h1 long, h2 long, m long, runs {RUNS}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Each text without the bytes that a string of `length` bytes covers which also starts elsewhere.

    Columns: doc_id, n_bytes, removed (array of start and end of each maximal run), kept (binary). Texts are UTF-8 bytes, null
    counts as empty, strings never cross texts, and are judged on the input. Texts shorter than `length` keep all.
    Repeated rows are texts of their own, so from `length` bytes on they lose everything; a null doc_id is a
    row like others. An empty table gives no rows; other columns are not read. Equal spans are told by a 128-bit BLAKE2 digest.
    """
    rows = staged(spans(docs, length, gram), "spans")
    any_ = [F.first(c).alias(c) for c in ("doc_id", "mark", "first", "count", "at")]
    distinct = staged(rows.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), *any_), "distinct_spans")
    anchors = staged(distinct.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("spans")).where("total > 1"), "anchors")
    shared = staged(attach(distinct, anchors, ["key"], "spans", small=True).withColumn("m", F.col("n")), "shared_spans")
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("count").alias("end"))).alias("runs")
    whole = shared.where("spans = 1").select("key", "h1", "h2", "m", all_)
    found = staged(whole.unionByName(_divided(_cut(docs, shared.where("spans > 1"), length, gram), length)), "found")
    hits = attach(rows, found, ["key", "h1", "h2"], "m", small=True)
    cover = F.transform("runs", lambda r: F.struct((F.col("first") + r.start).alias("start"), (F.col("first") + r.end + (length - 1)).alias("end")))
    hits = hits.select("doc_id", "mark", cover.alias("cover")).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    hits = hits.agg(F.flatten(F.collect_set("cover")).alias("cover"))
    rows = marked(docs)
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "cover")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            removed, kept = [], []
            for row, text in enumerate(texts):
                cuts = batch.column("cover").slice(row, 1).flatten()
                runs = union_of(cuts.field("start").to_numpy(), cuts.field("end").to_numpy()) if len(cuts) else []
                edges = [0, *[e for r in runs for e in r], len(text)]
                removed.append(runs)
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            cols = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), _run_rows(removed), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "removed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(each, f"doc_id {kind}, n_bytes long, removed {RUNS}, kept binary")


def union_of(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the stretches."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.end - r.start).alias("n_removed")
    return found.select("doc_id", "n_bytes", n_removed, F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
